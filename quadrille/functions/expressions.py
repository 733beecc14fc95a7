"""SPARQL expressions to typed values. Every error is a null; no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms as T
from .values import DATATYPES, NUMBERS, Value, boolean, comparable, ebv, equal, less, lexical, like, literal, node, nothing, number, same_term, string, term, text, when_kind

Lookup = Callable[[str], Value | None]


class Evaluator:
    """Compiles expressions against the variables of one relation."""

    def __init__(self, lookup: Lookup, exists: Callable[[tuple], Column] | None = None, base: str = "", functions: dict[str, Callable[..., Value]] | None = None):
        self.lookup, self.exists, self.base = lookup, exists, base
        self.functions = functions or {}

    def value(self, e: tuple) -> Value:
        kind = e[0]
        if kind == "var":
            return self.lookup(e[1]) or nothing()
        if kind == "term":
            return literal(e[1])
        if kind == "exists":
            flag = self.exists(e)
            return boolean(~flag if e[1] else flag)
        if kind == "call":
            return self.call(e[1], [self.value(x) for x in e[2]])
        return self.op(e[1], e[2])

    def test(self, e: tuple) -> Column:
        """Effective boolean value of an expression."""
        return ebv(self.value(e))

    def op(self, name: str, args: list[tuple]) -> Value:
        if name == "BOUND":
            v = self.lookup(args[0][1])
            return boolean(v.col.isNotNull() if v else F.lit(False))
        if name == "&&":
            return boolean(self.test(args[0]) & self.test(args[1]))
        if name == "||":
            return boolean(self.test(args[0]) | self.test(args[1]))
        if name == "!":
            return boolean(~self.test(args[0]))
        if name == "IF":
            return self.branches([(self.test(args[0]), self.value(args[1])), (~self.test(args[0]), self.value(args[2]))])
        if name == "COALESCE":
            vs = [self.value(a) for a in args]
            return self.branches([(v.col.isNotNull(), v) for v in vs])
        vs = [self.value(a) for a in args]
        if name == "IN":
            out = F.lit(False)
            for v in vs[1:]:
                out = out | equal(vs[0], v)
            return boolean(out)
        if name == "=":
            return boolean(equal(*vs))
        if name == "!=":
            return boolean(~equal(*vs))
        if name in ("<", "<=", ">", ">="):
            return boolean(less(vs[0], vs[1], name))
        if name in ("+", "-", "*", "/", "neg"):
            return self.arithmetic(name, vs)
        return getattr(self, f"f_{name.lower()}")(*vs)

    def branches(self, cases: list[tuple[Column, Value]]) -> Value:
        """The first case that holds; of one kind natively, else as terms."""
        kinds = {v.kind for _, v in cases}
        if len(kinds) == 1 and kinds.isdisjoint({"key", "term"}):
            out, get, kind = None, (lambda v: v.col), kinds.pop()
        elif kinds <= set(NUMBERS):
            kind = "dbl" if "dbl" in kinds else "dec"
            out, get = None, (lambda v: v.col.cast("double" if kind == "dbl" else "decimal(38,18)"))
        elif kinds <= {"key", "node"}:
            out, get, kind = None, lexical, "node"
        else:
            out, get, kind = None, term, "term"
        for test, v in cases:
            out = F.when(test, get(v)) if out is None else out.when(test, get(v))
        return Value(kind, out)

    def arithmetic(self, name: str, vs: list[Value]) -> Value:
        ns = [number(v) for v in vs]
        if any(n is None for n in ns):
            return Value("dbl", F.lit(None).cast("double"))
        if name == "neg":
            return ns[0].with_col(F.try_subtract(F.lit(0).cast("long") if ns[0].kind == "int" else F.lit(0.0) if ns[0].kind == "dbl" else F.lit(0).cast("decimal(38,18)"), ns[0].col))
        kinds = {n.kind for n in ns}
        x, y = (n.col for n in ns)
        if any(v.kind == "term" for v in vs):
            return self.mixed(name, vs, x.cast("double"), y.cast("double"))
        if "dbl" in kinds:
            x, y = x.cast("double"), y.cast("double")
            if name == "/":  # IEEE: x / 0 is infinite, 0 / 0 is no number
                inf = F.lit(float("inf"))
                return Value("dbl", F.when(y == 0, F.when(x > 0, inf).when(x < 0, -inf).when(x == 0, F.lit(float("nan")))).otherwise(F.try_divide(x, y)))
            return Value("dbl", {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[name](x, y))
        if kinds == {"int"}:
            x, y = x.cast("long"), y.cast("long")
            if name == "/":
                return Value("dec", F.try_divide(x.cast("decimal(20,0)"), y.cast("decimal(20,0)")).cast("decimal(38,18)"))
            return Value("int", {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[name](x, y))
        if name == "/":
            return Value("dec", F.try_divide(x.cast("decimal(28,9)"), y.cast("decimal(28,9)")).try_cast("decimal(38,18)"))
        if name == "*":
            return Value("dec", F.try_multiply(x.cast("decimal(28,9)"), y.cast("decimal(28,9)")).try_cast("decimal(38,18)"))
        return Value("dec", {"+": F.try_add, "-": F.try_subtract}[name](x.cast("decimal(38,18)"), y.cast("decimal(38,18)")).try_cast("decimal(38,18)"))

    @staticmethod
    def mixed(name: str, vs: list[Value], x: Column, y: Column) -> Value:
        """Arithmetic where a datatype is known only row by row: the result takes the wider one."""

        def has(v: Value, kinds: tuple[str, ...], datatypes) -> Column:
            return v.col["dt"].isin(*sorted(datatypes)) if v.kind == "term" else F.lit(v.kind in kinds)

        approx = has(vs[0], ("dbl",), {T.DOUBLE, T.FLOAT}) | has(vs[1], ("dbl",), {T.DOUBLE, T.FLOAT})
        whole = has(vs[0], ("int",), T.INTEGERS) & has(vs[1], ("int",), T.INTEGERS)
        if name == "/":
            inf = F.lit(float("inf"))
            zero = F.when(approx, F.when(x > 0, inf).when(x < 0, -inf).when(x == 0, F.lit(float("nan"))))
            z = F.when(y == 0, zero).otherwise(F.try_divide(x, y))
            whole = F.lit(False)
        else:
            z = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[name](x, y)
        dt = F.when(approx, T.DOUBLE).when(whole, T.INTEGER).otherwise(T.DECIMAL)
        exact = F.regexp_replace(F.regexp_replace(z.try_cast("decimal(38,15)").cast("string"), "0+$", ""), r"\.$", ".0")
        form = F.when(approx, z.cast("string")).when(whole, z.try_cast("decimal(38,0)").cast("string")).otherwise(exact)
        made = F.struct(F.lit(T.LITERAL_KIND).cast("tinyint").alias("k"), form.alias("v"), dt.alias("dt"), F.lit(None).cast("string").alias("lang"))
        return Value("term", F.when(form.isNotNull(), made))

    # terms
    def f_sameterm(self, a, b):
        return boolean(same_term(a, b))

    def _kind(self, v: Value, nodes: Callable[[Column], Column], lit: bool) -> Value:
        if v.kind in ("node", "key"):
            return boolean(nodes(lexical(v)))
        if v.kind == "term":
            s = F.when(v.col["k"] == T.LITERAL_KIND, F.lit(lit)).otherwise(nodes(v.col["v"]))
            return boolean(F.when(v.col.isNotNull(), s))
        return boolean(F.when(v.col.isNotNull(), F.lit(lit)))

    def f_isiri(self, v):
        return self._kind(v, lambda s: ~s.startswith("_:"), False)

    f_isuri = f_isiri

    def f_isblank(self, v):
        return self._kind(v, lambda s: s.startswith("_:"), False)

    def f_isliteral(self, v):
        return self._kind(v, lambda s: F.when(s.isNotNull(), F.lit(False)), True)

    def f_isnumeric(self, v):
        if v.kind == "term":
            n = number(v)
            return boolean(F.when(v.col.isNotNull(), n.col.isNotNull()))
        return boolean(F.when(v.col.isNotNull(), F.lit(v.kind in NUMBERS)))

    def f_str(self, v):
        if v.kind in ("node", "key"):
            s = lexical(v)
            return string(F.when(~s.startswith("_:"), s))
        if v.kind == "term":
            return string(F.when(v.col["k"] != T.BNODE_KIND, v.col["v"]))
        return string(lexical(v))

    def f_lang(self, v):
        if v.kind == "term":
            return string(F.when(v.col["k"] == T.LITERAL_KIND, F.coalesce(v.col["lang"], F.lit(""))))
        if v.kind in ("node", "key"):
            return nothing()
        return string(F.when(v.col.isNotNull(), F.lit("")))

    def f_datatype(self, v):
        if v.kind == "term":
            return Value("node", F.when(v.col["k"] == T.LITERAL_KIND, v.col["dt"]))
        if v.kind in ("node", "key"):
            return nothing()
        return Value("node", F.when(v.col.isNotNull(), F.lit(DATATYPES[v.kind])))

    def f_langmatches(self, tag, spec):
        t, s = F.lower(text(tag)), F.lower(text(spec))
        return boolean(F.when(s == "*", t != "").otherwise((t == s) | t.startswith(F.concat(s, F.lit("-")))))

    def f_iri(self, v):
        if v.kind in ("node", "key"):
            return v
        s = node(v) if v.kind == "term" else F.lit(None).cast("string")
        s = F.coalesce(s, text(v))
        if self.base:
            s = F.when(s.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), s).otherwise(F.concat(F.lit(self.base), s))
        return Value("node", s)

    f_uri = f_iri

    def f_bnode(self, v=None):
        # one blank node for one label in one solution, different ones between solutions
        row = F.monotonically_increasing_id().cast("string")
        return Value("node", F.concat(F.lit("_:r"), row, F.lit("-"), F.md5(text(v))) if v else F.concat(F.lit("_:u"), F.replace(F.uuid(), F.lit("-"), F.lit(""))))

    def f_strdt(self, v, dt):
        s, d = (v.col if v.kind == "str" else F.when(v.col["dt"] == T.STRING, v.col["v"]) if v.kind == "term" else F.lit(None).cast("string")), node(dt)
        made = F.struct(F.lit(T.LITERAL_KIND).cast("tinyint").alias("k"), s.alias("v"), d.alias("dt"), F.lit(None).cast("string").alias("lang"))
        return Value("term", F.when(s.isNotNull() & d.isNotNull(), made))

    def f_strlang(self, v, tag):
        s, lang = (v.col if v.kind == "str" else F.when(v.col["dt"] == T.STRING, v.col["v"]) if v.kind == "term" else F.lit(None).cast("string")), F.lower(text(tag))
        made = F.struct(F.lit(T.LITERAL_KIND).cast("tinyint").alias("k"), s.alias("v"), F.lit(T.LANG_STRING).alias("dt"), lang.alias("lang"))
        return Value("term", F.when(s.isNotNull() & (lang != ""), made))

    def f_uuid(self):
        return Value("node", F.concat(F.lit("urn:uuid:"), F.uuid()))

    def f_struuid(self):
        return string(F.uuid())

    def f_rand(self):
        return Value("dbl", F.rand())

    def f_now(self):
        return Value("dt", F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz"))

    # strings
    def f_strlen(self, v):
        return Value("int", F.char_length(text(v)).cast("long"))

    def f_substr(self, v, start, length=None):
        s = text(v)
        a = F.floor((number(start) or nothing()).col.cast("double") + 0.5).cast("int")
        if length is None:
            return like(v, F.substring(s, F.greatest(a, F.lit(1)), F.char_length(s)))
        end = a + F.floor((number(length) or nothing()).col.cast("double") + 0.5).cast("int")
        begin = F.greatest(a, F.lit(1))
        return like(v, F.when(end <= begin, F.when(s.isNotNull(), F.lit(""))).otherwise(F.substring(s, begin, end - begin)))

    def f_ucase(self, v):
        return like(v, F.upper(text(v)))

    def f_lcase(self, v):
        return like(v, F.lower(text(v)))

    def _compatible(self, a: Value, b: Value) -> Column:
        """Argument compatibility: the second is untagged, or both have one tag."""
        if b.kind != "term":
            return F.lit(True)
        lang = b.col["lang"]
        return lang.isNull() | (a.col["lang"] == lang if a.kind == "term" else F.lit(False))

    def _two(self, a, b, f):
        return F.when(self._compatible(a, b), f(text(a), text(b)))

    def f_strstarts(self, a, b):
        return boolean(self._two(a, b, lambda x, y: x.startswith(y)))

    def f_strends(self, a, b):
        return boolean(self._two(a, b, lambda x, y: x.endswith(y)))

    def f_contains(self, a, b):
        return boolean(self._two(a, b, lambda x, y: x.contains(y)))

    def _cut(self, a, b, after: bool):
        x, y = text(a), text(b)
        at = F.instr(x, y)
        found = F.substring(x, at + F.char_length(y), F.char_length(x)) if after else F.substring(x, F.lit(1), at - 1)
        hit = F.when(self._compatible(a, b) & (at > 0), found)
        if a.kind != "term":
            return string(F.when(self._compatible(a, b), F.when(at > 0, found).when(at == 0, F.lit(""))))
        miss = term(string(F.when(self._compatible(a, b) & (at == 0), F.lit(""))))
        return Value("term", F.coalesce(like(a, hit).col, miss))

    def f_strbefore(self, a, b):
        return self._cut(a, b, False)

    def f_strafter(self, a, b):
        return self._cut(a, b, True)

    def f_concat(self, *vs):
        joined = F.concat(*[text(v) for v in vs]) if vs else F.lit("")
        if all(v.kind == "str" for v in vs):
            return string(joined)
        langs = [v.col["lang"] if v.kind == "term" else F.lit(None).cast("string") for v in vs]
        same = langs[0]
        for x in langs[1:]:
            same = F.when(same == x, same)
        made = F.struct(F.lit(T.LITERAL_KIND).cast("tinyint").alias("k"), joined.alias("v"), F.when(same.isNotNull(), T.LANG_STRING).otherwise(T.STRING).alias("dt"), same.alias("lang"))
        return Value("term", F.when(joined.isNotNull(), made))

    def f_encode_for_uri(self, v):
        s = F.url_encode(text(v))
        for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
            s = F.replace(s, F.lit(a), F.lit(b))
        return string(s)

    @staticmethod
    def _pattern(p: Value, flags: Value | None) -> Column:
        pattern = text(p)
        if flags is None:
            return pattern
        f = text(flags)
        quoted = F.when(f.contains("q"), F.concat(F.lit("\\Q"), pattern, F.lit("\\E"))).otherwise(pattern)
        for c in "ismx":
            quoted = F.when(f.contains(c), F.concat(F.lit(f"(?{c})"), quoted)).otherwise(quoted)
        return quoted

    def f_regex(self, v, p, flags=None):
        return boolean(F.rlike(text(v), self._pattern(p, flags)))

    def f_replace(self, v, p, r, flags=None):
        return like(v, F.regexp_replace(text(v), self._pattern(p, flags), text(r)))

    # numbers
    def _number(self, v):
        return number(v) or Value("dbl", F.lit(None).cast("double"))

    def f_abs(self, v):
        n = self._number(v)
        return n.with_col(F.abs(n.col))

    def _keep(self, v, f):
        n = self._number(v)
        kind = {"int": "long", "dec": "decimal(38,18)", "dbl": "double"}[n.kind]
        return n.with_col(f(n.col).cast(kind))

    def f_round(self, v):
        return self._keep(v, lambda c: F.floor(c + F.lit(0.5)))

    def f_ceil(self, v):
        return self._keep(v, F.ceil)

    def f_floor(self, v):
        return self._keep(v, F.floor)

    # dates: zoned literals are read in their own zone
    def _field(self, v: Value, f: Callable[[Column], Column]) -> Column:
        if v.kind == "term":
            local = F.regexp_replace(v.col["v"], r"(Z|[+-]\d\d:\d\d)$", "").try_cast("timestamp_ntz")
            return f(F.when(when_kind(v).isNotNull(), local))
        return f(when_kind(v))

    def f_year(self, v):
        return Value("int", self._field(v, F.year).cast("long"))

    def f_month(self, v):
        return Value("int", self._field(v, F.month).cast("long"))

    def f_day(self, v):
        return Value("int", self._field(v, F.dayofmonth).cast("long"))

    def f_hours(self, v):
        return Value("int", self._field(v, F.hour).cast("long"))

    def f_minutes(self, v):
        return Value("int", self._field(v, F.minute).cast("long"))

    def f_seconds(self, v):
        return Value("dec", self._field(v, lambda c: F.extract(F.lit("SECOND"), c)).cast("decimal(38,18)"))

    def _zone(self, v: Value) -> Column:
        if v.kind != "term":
            return F.when(when_kind(v).isNotNull(), F.lit(""))
        return F.when(when_kind(v).isNotNull(), F.regexp_extract(v.col["v"], r"(Z|[+-]\d\d:\d\d)$", 1))

    def f_tz(self, v):
        return string(self._zone(v))

    def f_timezone(self, v):
        z = self._zone(v)
        h, m = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
        span = F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
        s = F.when((z == "Z") | z.endswith("00:00"), F.lit("PT0S")).when(z != "", span)
        made = F.struct(F.lit(T.LITERAL_KIND).cast("tinyint").alias("k"), s.alias("v"), F.lit(T.XSD + "dayTimeDuration").alias("dt"), F.lit(None).cast("string").alias("lang"))
        return Value("term", F.when(s.isNotNull(), made))

    # hashes
    def f_md5(self, v):
        return string(F.md5(text(v)))

    def f_sha1(self, v):
        return string(F.sha1(text(v)))

    def f_sha256(self, v):
        return string(F.sha2(text(v), 256))

    def f_sha384(self, v):
        return string(F.sha2(text(v), 384))

    def f_sha512(self, v):
        return string(F.sha2(text(v), 512))

    # casts, and functions registered by IRI
    def call(self, iri: str, vs: list[Value]) -> Value:
        if iri in self.functions:
            return self.functions[iri](*vs)
        if not iri.startswith(T.XSD) or len(vs) != 1:
            return nothing()
        name, v = iri[len(T.XSD) :], vs[0]
        s = lexical(v) if v.kind != "term" else F.when(v.col["k"] == T.LITERAL_KIND, v.col["v"])
        if v.kind in ("node", "key") and name != "string":
            return nothing()
        if name == "string":
            return self.f_str(v)
        if name in ("double", "float"):
            if v.kind == "bool":
                return Value("dbl", v.col.cast("double"))
            return Value("dbl", v.col.cast("double") if v.kind in NUMBERS else F.trim(s).try_cast("double"))
        if name == "decimal":
            if v.kind == "bool":
                return Value("dec", v.col.cast("int").cast("decimal(38,18)"))
            return Value("dec", v.col.try_cast("decimal(38,18)") if v.kind in NUMBERS else F.when(~F.lower(s).contains("e"), F.trim(s).try_cast("decimal(38,18)")))
        if name in ("integer", "long", "int", "short", "byte"):
            if v.kind == "bool":
                return Value("int", v.col.cast("long"))
            return Value("int", v.col.try_cast("long") if v.kind in NUMBERS else F.when(F.trim(s).rlike(r"^[+-]?\d+$"), F.trim(s).try_cast("long")) if v.kind != "term" else F.coalesce(F.when(F.trim(s).rlike(r"^[+-]?\d+$"), F.trim(s).try_cast("long")), F.floor(number(v).col).try_cast("long")))
        if name == "boolean":
            if v.kind in NUMBERS or v.kind == "bool":
                return boolean(ebv(v))
            return boolean(F.when(F.lower(F.trim(s)).isin("true", "1"), True).when(F.lower(F.trim(s)).isin("false", "0"), False))
        if name == "dateTime":
            return Value("dt", F.coalesce(when_kind(v), F.when(s.rlike(r"^-?\d{4,}-\d\d-\d\d"), s.try_cast("timestamp_ntz"))))
        if name == "date":
            return Value("date", F.coalesce(when_kind(v).cast("date"), F.when(s.rlike(r"^-?\d{4,}-\d\d-\d\d"), F.substring(s, 1, 10).try_cast("date"))))
        return nothing()


__all__ = ["Evaluator", "comparable"]

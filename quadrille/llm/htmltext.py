"""Main-text extraction with a recurrent block labeller.

A page becomes a sequence of leaf blocks: text between block-level tags, with the
path of open elements (tags, classes, ids). A numpy bidirectional LSTM reads the
hashed path and word vectors of the whole sequence and labels every block as main
text or not. It is trained here, on pages that ``synthetic_page`` writes.
Scripts, styles, head, form controls and comments never become blocks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import byte_texts

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<!--|<[!?/]""")
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+|©")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "select", "object", "xmp", "noframes", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img button input font".split())
#: A start tag of these closes an open p.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "body", "div", "article", "section", "menu"}
ENDS = {n: re.compile(f"</{n}(?=[\\s/>]|$)", re.IGNORECASE) for n in RAW}

BUCKETS, DIM, HIDDEN, NUMBERS = 2048, 24, 16, 5


def blocks(page: str) -> list[tuple[tuple[str, ...], str]]:
    """(path, text) of the leaf blocks, in page order; texts decoded, white space single, none empty."""
    out: list[tuple[tuple[str, ...], str]] = []
    stack: list[tuple[str, str]] = []  # (tag, description)
    parts: list[str] = []
    path: tuple[str, ...] = ()
    at, end, hidden = 0, len(page), 0

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((path, text))

    while at < end:
        m = TAG.search(page, at)
        if not m:
            if not hidden:
                parts.append(page[at:])
            break
        if m.start() > at and not hidden:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:  # a comment, doctype or instruction
            close = page.find("-->" if m[0] == "<!--" else ">", at)
            at = end if close < 0 else close + (3 if m[0] == "<!--" else 1)
            continue
        name = name.lower()
        if m[1] or m[4]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if any(t not in INLINE for t, _ in stack[i:]):
                        flush()
                    if any(t == "head" for t, _ in stack[i:]):
                        hidden = 0
                    del stack[i:]
                    path = tuple(d for _, d in stack)
                    break
            else:
                if name not in INLINE:
                    flush()
            continue
        if name in RAW:
            close = ENDS[name].search(page, at)
            at = close.start() if close else end
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE:
            continue  # inline elements don't end blocks and aren't on the path
        flush()
        if name in VOID:
            continue
        if name == "head":
            hidden = 1
        elif name == "body":
            hidden = 0
        if hidden and name in BLOCKS and name != "html":
            hidden = 0  # a head that was never closed ends at the first block
        if name in BLOCKS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES:
                    break
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in SIBLINGS.get(name, ()):
                del stack[i:]
                break
            if stack[i][0] in SCOPES:
                break
        names = " ".join(x for g in NAMES.findall(m[3] or m[6] or "") for x in g if x).lower()
        stack.append((name, f"{name} {names}"))
        path = tuple(d for _, d in stack)
    flush()
    return out


def _bucket(s: str) -> int:
    return xxhash.xxh32_intdigest(s) % BUCKETS


class Features:
    """Hashed feature lists of blocks, remembered by path."""

    def __init__(self):
        self.known: dict[tuple[str, ...], list[int]] = {}

    def path(self, path: tuple[str, ...]) -> list[int]:
        if path not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            found = {_bucket(f"leaf {path[-1].split()[0]}" if path else "leaf")}
            for d in path:
                tag, *names = d.split()
                found.add(_bucket(f"tag {tag}"))
                found.update(_bucket(f"name {x}") for n in names for x in re.split(r"[^a-z]+", n) if x)
            self.known[path] = sorted(found)
        return self.known[path]

    def of(self, block: tuple[tuple[str, ...], str]) -> tuple[list[int], list[int], list[float]]:
        path, text = block
        words = set(WORDS.findall(text.lower()))
        n = text.count(" ") + 1
        ends = text[-1] in ".!?:…\"'»"
        return self.path(path), [_bucket(f"word {w}") for w in words], [np.log1p(n) / 5, float(ends), text.count(",") / n, len(path) / 10, 1.0]


class Labeller:
    """Bidirectional LSTM over block vectors, one logit a block."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) * (1 / np.sqrt(s[0]))).astype(np.float32)
        self.p = {"path": r(BUCKETS, DIM) * 4, "word": r(BUCKETS, DIM) * 4, "num": r(NUMBERS, DIM), "out": r(2 * HIDDEN, 1), "skip": r(DIM, 1), "b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": r(DIM, 4 * HIDDEN), f"u{d}": r(HIDDEN, 4 * HIDDEN), f"c{d}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)}

    @staticmethod
    def _bag(table: np.ndarray, lists: list[list[int]], mean: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in lists])
        flat = np.array([i for x in lists for i in x], np.int64)
        owner = np.repeat(np.arange(len(lists)), n)
        out = np.zeros((len(lists), DIM), np.float32)
        full = np.flatnonzero(n)
        if len(flat):
            out[full] = np.add.reduceat(table[flat], (np.cumsum(n) - n)[full])
        scale = (1 / np.sqrt(np.maximum(n, 1)) if mean else np.ones(len(n))).astype(np.float32)
        return out * scale[:, None], flat, (owner, scale)

    def inputs(self, feats: list[tuple[list[int], list[int], list[float]]]):
        a, fa, oa = self._bag(self.p["path"], [f[0] for f in feats], False)
        b, fb, ob = self._bag(self.p["word"], [f[1] for f in feats], True)
        num = np.array([f[2] for f in feats], np.float32)
        return a + b + num @ self.p["num"], (fa, oa, fb, ob, num)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: (time, pages, DIM), in reading order of direction ``d``."""
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        wx = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        out, saved = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            z = wx[t] + h @ self.p[f"u{d}"]
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            m = mask[t][:, None]
            if keep:
                saved.append((h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c2, c)
            out[t] = h
        return out, saved

    def _back(self, x: np.ndarray, dout: np.ndarray, saved, d: str, grads: dict) -> np.ndarray:
        steps, n, _ = x.shape
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        dx = np.zeros_like(x)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tc, m = saved[t]
            dh = dh + dout[t]
            live = dh * m
            do = live * tc
            dct = np.where(m, dc, 0) + live * o * (1 - tc * tc)
            dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), do * o * (1 - o), dct * i * (1 - g * g)], axis=1)
            grads[f"w{d}"] += x[t].T @ dz
            grads[f"u{d}"] += h.T @ dz
            grads[f"c{d}"] += dz.sum(axis=0)
            dx[t] = dz @ self.p[f"w{d}"].T
            dh = np.where(m, dz @ self.p[f"u{d}"].T, dh)
            dc = np.where(m, dct * f, dc)
        return dx

    def forward(self, pages: list[list], keep: bool = False):
        counts = np.array([len(p) for p in pages])
        flat, saved_in = self.inputs([f for p in pages for f in p])
        steps, n = int(counts.max()), len(pages)
        at_t = np.concatenate([np.arange(c) for c in counts])
        at_n = np.repeat(np.arange(n), counts)
        x = np.zeros((steps, n, DIM), np.float32)
        x[at_t, at_n] = flat
        mask = np.arange(steps)[:, None] < counts[None]
        back_t = counts[at_n] - 1 - at_t
        y = np.zeros_like(x)
        y[back_t, at_n] = flat
        hf, sf = self._run(x, mask, "f", keep)
        hb, sb = self._run(y, mask, "b", keep)
        both = np.concatenate([hf[at_t, at_n], hb[back_t, at_n]], axis=1)
        logits = (both @ self.p["out"] + flat @ self.p["skip"])[:, 0] + self.p["b"]
        return logits, (flat, saved_in, x, y, mask, at_t, at_n, back_t, sf, sb, both)

    def train(self, pages: list[list], labels: list[list[int]], epochs: int = 10, batch: int = 24, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on the cross entropy, by back-propagation through time in both directions."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for s in range(0, len(order), batch):
                pick = order[s : s + batch]
                logits, (flat, (fa, oa, fb, ob, num), x, y, mask, at_t, at_n, back_t, sf, sb, both) = self.forward([pages[i] for i in pick], True)
                truth = np.concatenate([labels[i] for i in pick])
                d = ((1 / (1 + np.exp(-logits)) - truth) / len(truth)).astype(np.float32)[:, None]
                g = {k: np.zeros_like(p) for k, p in self.p.items()}
                g["out"], g["skip"], g["b"] = both.T @ d, flat.T @ d, d.sum(axis=0)
                dboth = d @ self.p["out"].T
                df, db = np.zeros(x.shape[:2] + (HIDDEN,), np.float32), np.zeros(x.shape[:2] + (HIDDEN,), np.float32)
                df[at_t, at_n], db[back_t, at_n] = dboth[:, :HIDDEN], dboth[:, HIDDEN:]
                dx, dy = self._back(x, df, sf, "f", g), self._back(y, db, sb, "b", g)
                dflat = d @ self.p["skip"].T + dx[at_t, at_n] + dy[back_t, at_n]
                np.add.at(g["path"], fa, (dflat * oa[1][:, None])[oa[0]])
                np.add.at(g["word"], fb, (dflat * ob[1][:, None])[ob[0]])
                g["num"] = num.T @ dflat
                step += 1
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.01 * (g[k] * g[k] - v[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def main_blocks(self, pages: list[list], batch: int = 128) -> list[np.ndarray]:
        """Which blocks of each page are main text. Pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        s = 0
        while s < len(order):
            # a group's padded size is bounded, so that one page of very many blocks stands alone
            most = max(1, min(batch, 200_000 // len(pages[order[min(s + batch, len(order)) - 1]])))
            pick = order[s : s + most]
            logits, _ = self.forward([pages[i] for i in pick])
            ends = np.cumsum([len(pages[i]) for i in pick])
            for i, part in zip(pick, np.split(logits > 0, ends[:-1])):
                out[i] = part
            s += most
        return out


_BODY = "the of and to in is that for it was on are be with as by this from at or an der die und das ein le la les des et un est que el los para con una del mit".split()
_MENU = "home about contact news login register search products services blog archive help faq shop cart account next previous more categories tags".split()
_LEGAL = "copyright © rights reserved privacy policy terms imprint cookies consent accept settings agree use".split()
_SOCIAL = "share tweet follow subscribe newsletter email sign up free join now".split()
_ADS = "advertisement sponsored buy sale offer discount deal click here shop".split()
_TALK = "reply comments said posted great thanks agree wrong user ago report like".split()
_SYLLABLES = "an er on en st re in at th ou es ing ti le ra ment de que ion lich ver ein pf ado os cio el ai eau".split()


def synthetic_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page and, for each of its blocks, whether it is main text. Boilerplate surrounds, and at times interrupts, one article."""
    lexicon = ["".join(rng.choice(_SYLLABLES, rng.integers(1, 4))) for _ in range(60)]
    out: list[str] = []
    labels: list[int] = []

    def words(n, extra=()):
        pool = list(extra) if len(extra) and rng.random() < 0.8 else lexicon
        mixed = [str(rng.choice(pool if len(extra) else (_BODY if rng.random() < 0.4 else lexicon))) for _ in range(n)]
        return " ".join(mixed)

    def block(tag, text, main, attrs=""):
        out.append(f"<{tag}{attrs}>{text}" + ("" if tag in ("p", "li") and rng.random() < 0.2 else f"</{tag}>"))
        labels.append(int(main))

    def box(names, tags, fill, extra, main=0):
        tag, name = str(rng.choice(tags)), str(rng.choice(names))
        key = "class" if rng.random() < 0.7 else "id"
        plain = tag not in ("div", "section")
        attrs = "" if plain and rng.random() < 0.7 else f' {key}="{name}{rng.choice(["", "-box", " wide", "_1"])}"'
        out.append(f"<{tag}{attrs}>")
        fill(extra, main)
        out.append(f"</{tag}>")

    def links(extra, main):
        out.append("<ul>")
        for _ in range(rng.integers(2, 8)):
            block("li", f'<a href="/x">{words(rng.integers(1, 3), extra)}</a>', main)
        out.append("</ul>")

    def lines(extra, main):
        for _ in range(rng.integers(1, 4)):
            block(str(rng.choice(["p", "div", "p"])), words(rng.integers(2, 25), extra).capitalize() + str(rng.choice([".", ""])), main)

    def bare(extra, main):
        out.append(words(rng.integers(3, 14), extra) + str(rng.choice([".", ""])))
        labels.append(int(main))

    def boiler(where):
        kinds = [
            (["nav", "menu", "navbar", "breadcrumb", "navigation", "toolbar"], ["nav", "div", "div"], links, _MENU),
            (["ad", "ads", "advert", "sponsor", "banner", "promo"], ["div", "aside", "section"], bare if rng.random() < 0.6 else lines, _ADS if rng.random() < 0.5 else ()),
            (["sidebar", "widget", "related", "recent"], ["aside", "div"], links if rng.random() < 0.5 else lines, _SOCIAL if rng.random() < 0.5 else ()),
            (["cookie", "notice", "consent", "alert", "popup", "modal"], ["div", "section"], lines if rng.random() < 0.5 else bare, _LEGAL),
            (["share", "social", "newsletter", "subscribe"], ["div", "form", "section"], lines, _SOCIAL),
        ]
        if where == "top":
            kinds += [(["header", "masthead", "site", "logo"], ["header", "div"], bare if rng.random() < 0.5 else lines, _MENU if rng.random() < 0.5 else ())] * 2
        if where == "end":
            kinds += [
                (["footer", "copyright", "legal", "bottom"], ["footer", "footer", "div"], bare if rng.random() < 0.7 else links, _LEGAL if rng.random() < 0.5 else ()),
                (["comments", "comment", "respond", "discussion", "replies"], ["div", "section", "section"], lines, _TALK if rng.random() < 0.6 else ()),
            ] * 2
        k = kinds[rng.integers(len(kinds))]
        box(*k)

    out.append('<!DOCTYPE html><html><head><title>x</title><script>var a="</p>";</script></head><body>')
    for _ in range(rng.integers(0, 4)):
        boiler("top")
    tag = str(rng.choice(["article", "article", "main", "div", "section"]))
    attrs = f' class="{rng.choice(["content", "post", "entry", "article", "story", "text", "main", "body"])}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
    out.append(f"<{tag}{attrs}>")
    for i in range(rng.integers(1, 16)):
        r = rng.random()
        if i == 0 and r < 0.8 or r < 0.06:
            block(str(rng.choice(["h1", "h2", "h3"])), words(rng.integers(1, 10)).capitalize(), 1)
        elif r < 0.12:
            for _ in range(rng.integers(1, 5)):
                out.append("<ul>")
                block("li", words(rng.integers(1, 12)), 1)
                out.append("</ul>")
        elif r < 0.17:
            block("blockquote" if rng.random() < 0.5 else "pre", words(rng.integers(3, 30)), 1)
        elif r < 0.22:
            boiler("in")
        else:
            text = words(rng.integers(1, 70) if rng.random() < 0.65 else rng.integers(1, 7)).capitalize() + str(rng.choice([".", ".", ".", "", "!", "***"]))
            block("p", f"<b>{text}<br>" if rng.random() < 0.1 else text, 1)
    out.append(f"</{tag}>")
    for _ in range(rng.integers(0, 5)):
        boiler("end")
    if rng.random() < 0.8:
        out.append("</body></html>")
    return "".join(out), labels


def trained(pages: int = 1200, seed: int = 1) -> Labeller:
    rng, model, f = np.random.default_rng(seed), Labeller(), Features()
    feats, labels = [], []
    for _ in range(pages):
        page, want = synthetic_page(rng)
        found = blocks(page)
        if found and len(found) == len(want):
            feats.append([f.of(b) for b in found])
            labels.append(want)
    model.train(feats, labels)
    return model


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """One row per page: id, url, text, n_chars.

    Blocks labelled as main text, decoded, each with single spaces, joined by one
    \\n in page order. Null, empty and blockless pages have an empty text; broken
    markup is read as browsers do, as far as blocks go; very long pages are read
    whole; repeated rows get a row each; an empty table gives no rows; columns
    not named aren't read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            raw = byte_texts(batch.column(2))
            texts: list[str] = []
            for at in range(0, len(raw), 256):
                found = [blocks(x.decode("utf-8", "replace")) for x in raw[at : at + 256]]
                for page, main in zip(found, shared.value.main_blocks([[features.of(b) for b in page] for page in found])):
                    texts.append("\n".join(t for (_, t), keep in zip(page, main) if keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(pages[id_col], pages[url_col].cast("string").alias(url_col), pages[html_col].cast("string").alias(html_col))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")

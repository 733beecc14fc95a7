"""Findings as text, JSON and code-quality reports."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from dataclasses import asdict

from ..checks.model import ERROR, Finding

QUALITY = {"ERROR": "major", "WARNING": "minor", "INFO": "info", "HINT": "info"}


def text(findings: dict[str, list[Finding]]) -> str:
    """One line a finding, by file, and totals."""
    lines, totals = [], Counter()
    for path, fs in findings.items():
        for f in fs:
            totals[f.severity] += 1
            lines.append(f"{path}:{f.line or 1}:{f.column or 1}: {f.severity.lower()}: {f.message} [{f.code}]")
    lines.append(", ".join(f"{n} {s.lower()}" for s, n in totals.items()) or "no findings")
    return "\n".join(lines)


def as_json(findings: dict[str, list[Finding]]) -> str:
    return json.dumps({"files": [{"path": p, "findings": [asdict(f) for f in fs]} for p, fs in findings.items()]}, indent=2)


def code_quality(findings: dict[str, list[Finding]]) -> str:
    out = []
    for path, fs in findings.items():
        for f in fs:
            mark = hashlib.md5(f"{path}/{f.code}/{f.term}/{f.line}/{f.column}".encode()).hexdigest()
            out.append({"description": f.message, "check_name": f.code, "fingerprint": mark, "severity": QUALITY[f.severity], "location": {"path": path, "lines": {"begin": f.line or 1}}})
    return json.dumps(out, indent=2)


def exit_code(findings: dict[str, list[Finding]], failed: bool = False) -> int:
    """0: no errors, 1: errors found, 2: the run failed."""
    return 2 if failed else int(any(f.severity == ERROR for fs in findings.values() for f in fs))

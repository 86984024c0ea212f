"""Secret scans by assignment-aware lexing (operator 10).

Source and configuration syntax is lexed into (name, literal) pairs: ``name = "x"``, ``name: x``, ``name := x``,
``"name" => 'x'``, ``--name=x``, ``name: type = "x"``, ``<name>x</name>``. Names are split into lower-case parts; a literal's score is the highest weight of a
sensitive part or pair of parts in the names it reaches. A name that holds a literal can be assigned on
(``db = "x"; password = db``): such constants are propagated to a fixed point within the document,
and the literal is scored by every name it reaches. Literals that score at least MIN_SCORE and look like values are spans of kind
``lexed``. Three base patterns give spans of kinds ``assign``, ``access`` and ``hex``; they always stay.

Defined results: null or empty text has no spans (the digest of the empty string); offsets are code
points, end exclusive; repeated rows get equal results; every text is read whole; other columns are
left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from keyloom.llm.common import pieces, table

KINDS = ("assign", "access", "hex", "lexed")
#: Base patterns, fixed by the contract; minimum lengths of group 2, of the match, and of the match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run of capitals and digits is matched whole, so the minimum can stand in the pattern
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
MIN_ASSIGN = 8
#: Weights of name parts.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0,
    "accesskey": 1.0, "secretkey": 1.0, "authtoken": 1.0, "bearer": 0.8, "auth": 0.6, "key": 0.4, "pass": 0.7, "salt": 0.5, "signature": 0.5,
}
MIN_SCORE = 0.7
MIN_LITERAL = 8
#: A run of name characters is matched whole and at its start only, so long names cost no more than short ones.
_PAIR = re.compile(
    r"""(?:(?P<q>["'])(?P<qname>[A-Za-z_][\w.\-]*+)(?P=q)|(?<![\w.\-])(?>[\w.\-]*?(?<![\w.])(?P<name>[A-Za-z_][\w.\-]*+)))[ \t]*"""
    r"""(?::[ \t]*(?P<type>[&*]*[A-Za-z_][\w.]*+(?:\[[^\n=\[\]]*+(?:\[[^\n=\[\]]*+\][^\n=\[\]]*+)*+\])?\??(?:[ \t]*\|[ \t]*[A-Za-z_][\w.]*+)*+)[ \t]*=(?![=>])|=>|:=|[:=](?!=))[ \t]*"""
    r"""(?:"(?P<d>[^"\n]*)"|'(?P<s>[^'\n]*)'|(?P<bare>[^\s"'`,;(){}\[\]<>]+))"""
    r"""|<(?P<tag>[A-Za-z_][\w.\-]*+)>(?P<body>[^<\n]*)</(?P=tag)>""",
    re.ASCII,
)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""", re.ASCII)
#: A name that is assigned to.
_NEXT = re.compile(r"([A-Za-z_][\w.\-]*+)[ \t]*(?:=>|:=|[:=](?!=))", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_IDENT = re.compile(r"[A-Za-z_][\w.\-]*\Z", re.ASCII)


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    return max((SENSITIVE.get(x, 0.0) for x in [*parts, *(a + b for a, b in zip(parts, parts[1:], strict=False))]), default=0.0)


def lex(text: str) -> list[tuple[str, int, int, str, bool]]:
    """(name, start, end, kind, inner) of every assignment.

    The literal is text[start:end]. Its kind is "lit", "bare", or "type" or "next" for a bare word that is itself assigned to, as in
    ``name: type = "x"`` and ``a = b = "x"``. Such a word is a value, a type or a name, so it is read as a name too, then with inner set.
    """
    out = []
    pos, inner_at = 0, -1
    while m := _PAIR.search(text, pos):
        pos = m.end()
        name = m["name"] or m["qname"] or m["tag"]
        inner = m.start("name") == inner_at
        group = next(g for g in ("d", "s", "bare", "body") if m[g] is not None)
        start, end = m.span(group)
        if m["type"] is not None:
            inner_at = pos = m.start("type")
            if b := _BARE.match(text, pos):
                out.append((name, *b.span(), "type", inner))
            out.append((name, start, end, "bare" if group == "bare" else "lit", inner))
            continue
        out.append((name, start, end, "bare" if group == "bare" else "lit", inner))
        while group == "bare" and (n := _NEXT.match(text, start)):
            out[-1] = (*out[-1][:3], "next", inner)
            if n.end() >= end:
                # the word's own literal stands behind it
                if n.end(1) < end:
                    out.append((name, *n.span(1), "next", inner))
                inner_at = pos = start
                break
            start, name, inner = n.end(), n[1], True
            out.append((name, start, end, "bare", inner))
    return out


def sensitive_literals(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that reach a sensitive name, directly or through other names."""
    held: dict[str, set[int]] = {}
    pairs = lex(text)
    scores = [0.0] * len(pairs)
    uses: list[tuple[str, str]] = []
    named = {name for name, *_ in pairs}
    outer = {name for name, *_, inner in pairs if not inner}
    longest = max(map(len, named), default=0)
    for i, (name, start, end, kind, _) in enumerate(pairs):
        literal = text[start:end] if kind != "lit" and end - start <= longest else None
        known = literal != name and literal in (outer if kind == "type" else named) and bool(_IDENT.match(literal))
        if known:
            uses.append((name, literal))
        if not known or kind == "next" and literal not in outer:
            held.setdefault(name, set()).add(i)
    # names whose value flows into a name; they are followed from the most sensitive name on, each once
    flows: dict[str, set[str]] = {}
    for name, source in uses:
        flows.setdefault(name, set()).add(source)
    best: dict[str, float] = {}
    for score, name in sorted(((name_score(n), n) for n in named), reverse=True):
        if score < MIN_SCORE:
            break
        todo = [name]
        while todo:
            n = todo.pop()
            if n in best:
                continue
            best[n] = score
            todo += flows.get(n, ())
    for name, score in best.items():
        for i in held.get(name, ()):
            scores[i] = max(scores[i], score)
    out: dict[tuple[int, int], float] = {}
    for (_, start, end, *_), score in zip(pairs, scores, strict=True):
        if score >= MIN_SCORE and end - start >= MIN_LITERAL and _looks_like_value(text[start:end]):
            out[start, end] = max(score, out.get((start, end), 0.0))
    return [(*span, score) for span, score in out.items()]


def _looks_like_value(literal: str) -> bool:
    """Placeholders and prose aren't secrets: no blanks, no template marks, not one lower-case word."""
    return not re.search(r"\s|\$\{|\{\{|<|>|%\(|\*{3}|x{4}", literal) and bool(re.search(r"[0-9A-Z+/_=-]", literal))


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    out = []
    signs = ":" in text or "=" in text
    if signs:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if signs or "</" in text:
        out += [("lexed", a, b) for a, b, _ in sensitive_literals(text)]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in pieces(batches):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t or "")] for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def row(text: str | None):
        found = find_secrets(text or "")
        names = [f"{k}:{a}:{b}" for k, a, b in found]
        base = ",".join(n for n, (k, _, _) in zip(names, found, strict=True) if k != "lexed")
        return *(sum(x[0] == k for x in found) for k in KINDS[:3]), hashlib.sha256(base.encode()).hexdigest(), ",".join(names)

    def run(batches):
        for b in pieces(batches):
            *counts, sha, spans = zip(*map(row, b.column(1).to_pylist()), strict=True)
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    docs = table(spark, sf_dir, "documents")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

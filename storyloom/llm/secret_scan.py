"""Secret scans by assignment-aware lexing.

Three base rules find keyword assignments, access keys and hex runs.  Beyond
them a small lexer reads source and configuration syntax into (name, value)
pairs: ``name = "literal"``, ``"name": 'literal'``, ``name := literal``,
``name => literal``, ``name: type = literal``, ``Name: Bearer literal``, ``export NAME=literal``, ``<name>literal</name>`` and
``--name literal``.  Constants propagate: in ``k = "..."``, ``password = k``
and ``password = part + "rest"`` the literals that reach a sensitive name are
scored under it.  A literal is reported when the product of its name's weight
and its own plausibility (length, character classes, entropy, not a placeholder)
reaches ``THRESHOLD``.

Each document is lexed on its own in the scan stage, so nothing is shuffled and
a lost executor costs only its splits.  Defined cases: null and empty texts have
no spans; every row gives one row; texts are read whole; a literal overlapping a
base span is not reported again; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: In the order of the contract; the method's own kind comes last.
KINDS = ("assign", "access", "hex", "literal")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

NAME = r"[A-Za-z_$][A-Za-z0-9_$.-]*+"
QUOTED = r'"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|`[^`\n]*+`'
ATOM = rf"(?:{QUOTED}|[A-Za-z0-9_$.+/=~!@#%^&*-]++)"
#: A type before ``=``: any with a space after it, or a common one (``env: KEY=abc`` is no typed assignment).
TYPED = r""":[ \t]*+(?:[A-Za-z_][A-Za-z0-9_.]{0,63}+(?:[\[<][A-Za-z0-9_., |\[\]<>]{0,64}+)?(?:[ \t]*+\|[ \t]*+[A-Za-z_][A-Za-z0-9_.]{0,63}+){0,4}+[ \t]*+(?<=[ \t])=|(?:str|string|String|bytes)=)(?![=>])"""
#: The scheme before a token, and an unquoted value that is a pair of its own.
SCHEME = r"""(?:["']?(?i:bearer|basic)[ \t]++(?=[A-Za-z0-9]))?"""
NESTED = r"""(?![A-Za-z_][A-Za-z0-9_]*+=[A-Za-z0-9_$.+/~"'-])"""
PAIR = re.compile(rf"""(?<![A-Za-z0-9_$.-])["']?({NAME})["']?[ \t]*+(?:{TYPED}|:=|=>|==?(?!=)|:(?![:/]))[ \t]*+{SCHEME}{NESTED}({ATOM}(?:[ \t]*+\+[ \t]*+{ATOM})*)""")
TAG = re.compile(rf"<({NAME})>([^<>\s]++)</\1>")
FLAG = re.compile(rf"(?<!\S)--({NAME})[ \t]++([^\s-]\S*+)")
PART = re.compile(ATOM)

#: How strongly a word of a name points to a secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
             "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "auth": 0.7, "authorization": 0.8, "pass": 0.7,
             "signature": 0.6, "salt": 0.6, "pin": 0.5, "dsn": 0.6}
#: A key is secret by the word before it.
KEY_OF = {"api": 1.0, "access": 0.9, "private": 1.0, "secret": 1.0, "encryption": 0.9, "signing": 0.9, "account": 0.8, "master": 0.8,
          "license": 0.5, "ssh": 0.8}
PLACEHOLDER = re.compile(r"(?i)example|change.?me|placeholder|your[-_ ]|dummy|sample|redacted|^(null|none|nil|true|false|undefined|todo|test)$|^[x*.#-]+$|^<.*>$|^\$[{(]|^%.*%$")
THRESHOLD = 0.5


def name_weight(name: str) -> float:
    words = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", name)
    words = [w.lower() for w in words]
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    for a, b in zip(words, words[1:], strict=False):
        if b in ("key", "keys"):
            best = max(best, KEY_OF.get(a, 0.0))
    return best


def plausibility(literal: str) -> float:
    """From 0 to 1: how much a literal looks like key material rather than prose or a reference."""
    n = len(literal)
    if n < 8 or PLACEHOLDER.search(literal) or any(c.isspace() for c in literal):
        return 0.0
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    classes = sum((any(c.islower() for c in literal), any(c.isupper() for c in literal), any(c.isdigit() for c in literal),
                   any(not c.isalnum() for c in literal)))
    if classes == 1 and not literal.isdigit() and n < 20 or literal.startswith(("/", "./", "http://", "https://")) and "@" not in literal:
        return 0.0
    return min(1.0, entropy / 3.5) * (0.6 + 0.2 * min(classes - 1, 2))


def parts(text: str, start: int, end: int) -> Iterator[tuple[bool, int, int]]:
    """The atoms of a value: whether quoted, and the span inside the quotes."""
    for m in PART.finditer(text, start, end):
        quoted = m[0][0] in "\"'`" and len(m[0]) > 1 and m[0][-1] == m[0][0]
        if m[0] != "+":
            yield quoted, m.start() + quoted, m.end() - quoted


class Value:
    """What an assignment holds: its own literals, and the constants it uses."""

    __slots__ = ("spans", "uses", "weight")

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []
        self.uses: list[Value] = []
        self.weight = 0.0  # the most sensitive name that reached it so far


def reached(text: str, value: Value, weight: float) -> set[tuple[int, int]]:
    """The literals below ``value`` that look like secrets under a name of this weight."""
    found, todo = set(), [value]
    while todo:
        at = todo.pop()
        if at.weight >= weight:
            continue
        at.weight = weight
        found.update((s, e) for s, e in at.spans if weight * plausibility(text[s:e]) >= THRESHOLD)
        todo += at.uses
    return found


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name and look like secrets."""
    if "=" not in text and ":" not in text and "</" not in text and "--" not in text:
        return []
    pairs = [(m.start(), m[1], m.start(2), m.end(2)) for m in PAIR.finditer(text)]
    if "</" in text:
        pairs += [(m.start(), m[1], m.start(2), m.end(2)) for m in TAG.finditer(text)]
    if "--" in text:
        pairs += [(m.start(), m[1], m.start(2), m.end(2)) for m in FLAG.finditer(text)]
    constants: dict[str, Value] = {}
    found: set[tuple[int, int]] = set()
    for _, name, start, end in sorted(pairs):
        value = Value()
        for quoted, s, e in parts(text, start, end):
            known = None if quoted else constants.get(text[s:e])
            if known is None:
                value.spans.append((s, e))
            else:
                value.uses.append(known)
        constants[name] = value
        if weight := name_weight(name):
            found |= reached(text, value, weight)
    return sorted(found)


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, found) as sorted (start, kind, end)."""
    low = text.lower()
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if any(k in low for k in KEYWORDS) else []
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    found = [(s, 3, e) for s, e in literals(text) if not any(b < e and s < f for b, _, f in base)]
    return base, found


def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        both = [spans(text or "") for text in batch.column("text").to_pylist()]
        cols = [pa.array([[{"kind": k, "start": s, "end": e} for s, k, e in x[i]] for x in both], of) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *cols], names=["doc_id", "base", "found"])


def find(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, base array<span>, found array<span>``."""
    span = "array<struct<kind:int,start:int,end:int>>"
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id long, base {span}, found {span}")

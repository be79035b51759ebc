"""Secret scan: patterns for known shapes, and sliding-window entropy for unknown ones.

Spans are ``kind:start:end`` in code points, end exclusive. Kinds, in the order of ties at a start:

``assign``   a credential word, a sign, a value of six or more characters
``access``   ``AKIA`` and capitals or digits, 20 or more in all
``hex``      24 or more of ``0-9a-f``
``entropy``  found by the method below

Method. Candidates are runs of 20 or more characters that keys are made of. Inside a candidate, each
maximal stretch of a character class (hexadecimal of one case; letters of one case and digits; letters,
digits and ``+/_-``) is walked with a window of fixed width. Character counts and the sum of c log2 c are kept up to date with the one
character that enters and the one that leaves, so a step costs the same for any width. Windows whose
Shannon entropy reaches the class's threshold are merged into spans. UUIDs, sequences of letters or digits,
fillers and placeholder words that stand alone are cut out first, and the rest on each side is walked by
itself. A span is suppressed if it is digits only, if a placeholder word is part of it, or if it is made of
words by their shape: parts of one case or title case, few changes between letters and digits, and
letter pairs that languages use. Spans that a base span already covers are not repeated.

A null text is empty and has no spans. Repeated rows give repeated results. Nothing is shuffled, and a
task holds one Arrow batch.
"""
from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import session

# The text is searched as lower-cased UTF-8: bytes.lower() changes ASCII letters only.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
#: name, stretch, window, bits
CLASSES = (("hex", re.compile(rb"[0-9a-f]{20,}|[0-9A-F]{20,}"), 20, 2.9),
           ("one case", re.compile(rb"[a-z0-9]{20,}|[A-Z0-9]{20,}"), 20, 3.3),
           ("base64", re.compile(rb"[A-Za-z0-9+/_-]{20,}"), 20, 3.6))
RISING = b"|".join(row[i:j] for row in (b"01234567890", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
                   for i in range(len(row) - 5) for j in range(len(row), i + 5, -1))  # six or more in a row, longest first
#: what is no part of a secret and may stand beside one
CUT = re.compile(rb"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[xX]{4,}|0{6,}|"
                 rb"(?<![A-Za-z0-9])(?i:example|placeholder|changeme|your)(?![A-Za-z0-9])|" + RISING)
PLACEHOLDER = re.compile(rb"(?i)example|placeholder|changeme")
TOKEN = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: letter pairs that make up most of the words of languages in Latin letters
PAIRS = frozenset("""th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra
    ld ur ch ie ei ge be un ic ne me li ri ro io co ma us el la ta ce ec om ll ho no il di em ac ee ss tr ns wa po lo ot ig ly sh ni
    ct so ai sc sp pe pr pl bl ab ad am ag ap av ay bi bo br ca ci cl cr da do ef ep ev ew ex fa fe fi fo fr ga gh gi go gr id if im
    ir iv ke ki lt mi mo mp mu na ny ob od ol oo op os ow pa pi pp rd rg rk rm rn rr rs rt ru ry su tt tu tw ty ub ue ui ul um up ut
    va vi we wh wi wo ck mm nn nc ff qu ba bu""".split())
KINDS = ("assign", "access", "hex", "entropy")

_terms = [0.0] + [c * math.log2(c) for c in range(1, 65)]


def hot_windows(run: bytes, width: int, bits: float) -> list[tuple[int, int]]:
    """Merged stretches of ``run`` all of whose windows have at least ``bits`` of entropy."""
    if len(run) < width:
        return []
    least = width * (math.log2(width) - bits)  # entropy >= bits where the sum of c log2 c is at most this
    counts, total, out = [0] * 256, 0.0, []
    for i, c in enumerate(run):
        total += _terms[counts[c] + 1] - _terms[counts[c]]
        counts[c] += 1
        if i >= width:
            old = run[i - width]
            counts[old] -= 1
            total += _terms[counts[old]] - _terms[counts[old] + 1]
        start = i + 1 - width
        if start >= 0 and total <= least + 1e-9:
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def is_word(part: bytes) -> bool:
    """Whether a part between signs has the shape of words and numbers."""
    if len(part) < 4 or part.isdigit():
        return True
    tokens = TOKEN.findall(part)
    letters = [t for t in tokens if not t.isdigit()]
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(tokens, tokens[1:]))
    if turns > max(1, len(part) // 8) or sum(map(len, letters)) < 3 * len(letters):
        return False
    found = [t[i:i + 2].lower().decode() for t in letters for i in range(len(t) - 1)]
    return len(found) < 5 or sum(x in PAIRS for x in found) >= 0.6 * len(found)


def allowed(found: bytes) -> bool:
    """Whether a span is something harmless."""
    if found.isdigit() or PLACEHOLDER.search(found):
        return True
    return sum(len(p) for p in re.split(rb"[+/_-]", found) if not is_word(p)) < 10


def secret_parts(text: bytes, width: int, bits: float) -> list[tuple[int, int]]:
    """The hot stretches of ``text`` that are not allowed, with what is harmless cut out first."""
    out, at = [], 0
    for start, end in [*(m.span() for m in CUT.finditer(text)), (len(text), len(text))]:
        out += [(at + a, at + b) for a, b in hot_windows(text[at:start], width, bits) if not allowed(text[at + a:at + b])]
        at = end
    return out


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """Byte spans ``start, kind, end`` of the three patterns."""
    out = []
    if b":" in data or b"=" in data:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data.lower()) if m.end(1) - m.start(1) >= 6]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    return out


def entropy_spans(data: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found = []
    for candidate in CANDIDATE.finditer(data):
        at, text = candidate.start(), candidate.group()
        for _, stretch, width, bits in CLASSES:
            for part in stretch.finditer(text):
                begin = at + part.start()
                found += [(begin + a, begin + b) for a, b in secret_parts(part.group(), width, bits)]
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return [(a, 3, b) for a, b in merged if not any(s <= a and b <= e for s, _, e in base)]


def to_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if len(data) == 0 or data.isascii():
        return sorted(spans)
    where, at, points = {}, 0, 0
    for position in sorted({x for s, _, e in spans for x in (s, e)}):
        points += len(data[at:position].decode("utf-8", "replace"))
        at = position
        where[position] = points
    return sorted((where[s], k, where[e]) for s, k, e in spans)


def scan_text(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, as ``start, kind number, end``, sorted."""
    data = (text or "").encode("utf-8", "replace")
    base = base_spans(data)
    return to_code_points(data, base), to_code_points(data, base + entropy_spans(data, base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, counts, digest of the base spans, and all spans."""
    session(docs.sparkSession)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def found_in(texts: pd.Series) -> pd.DataFrame:
        found = [scan_text(t) for t in texts]
        kinds = [[k for _, k, _ in base] for base, _ in found]
        return pd.DataFrame({
            "n_assign": [k.count(0) for k in kinds], "n_access": [k.count(1) for k in kinds], "n_hex": [k.count(2) for k in kinds],
            "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found],
            "spans": [joined(every) for _, every in found]})

    return own.select("doc_id", found_in("text").alias("found")).select("doc_id", "found.*")

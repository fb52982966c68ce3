"""Secret scan: three base patterns, plus assignment-aware lexing of source and configuration text.

Base kinds, leftmost and non-overlapping within a kind: ``assign`` (a sensitive name, a sign and a
value of 8 or more characters), ``access`` (access key ids), ``hex`` (32 or more hex digits).

The lexer walks the assignment signs (``=``, ``:``, ``:=``, ``=>``) of a text and parses each into a
name and a value: quoted literals with escapes, or bare words.  ``name: type = value`` assigns to the
name; where the type is a single word that is not a usual type's, it counts as a name too.  A bare
word that names a constant assigned elsewhere in the text stands for the literals that constant may
hold, over any chain of names: the nearest one before, those before it as long as the later ones are
indented deeper than the use, and all later ones if none is before.  A
literal is a finding if its score and that of the name it reaches are high enough together:
kind ``literal`` for a direct assignment, ``constant`` for one by way of other names.  Its span is
the literal without quotes.  Findings inside a base span are not repeated.

Positions are code points, ends exclusive.  Edge cases: null and empty texts have no spans; ties are
ordered by start, then kind as in ``KINDS``, then end; repeated rows give the same spans.  The
result column must have a new name; other columns pass through.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in their order, and the base patterns with the least length of what follows.
KINDS = ("assign", "access", "hex", "literal", "constant")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: Parts of names and how sensitive they are.
NAME_SCORES = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3,
    "credential": 3, "credentials": 3, "bearer": 3, "auth": 2, "authorization": 2, "pass": 2, "salt": 2,
}
KEY_OWNERS = {"api", "access", "private", "secret", "auth", "signing", "encryption", "master", "account"}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "****", "none", "null", "true", "false")
LEAST_LITERAL, LEAST_SCORE = 8, 4
#: Bits per character of a random-looking literal (3, less what rounding may take).
LEAST_ENTROPY = 3 - 1e-9

SIGN = re.compile(r"[:=]")
QUOTED = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\.)*+){q}") for q in "\"'`"}
BARE = re.compile(r"[^\s\"'`,;(){}<>\[\]]+")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*")
#: A type and the ``=`` of a value after it; group 1 is set where the type is a single plain word.
_INSIDE = r"(?:[^\n=;{}:]|::){0,200}"
_ONE_TYPE = (rf"(?:&[ ]?(?:'[a-z_]+[ ]+)?(?:mut[ ]+)?)?(?:[A-Za-z_][A-Za-z0-9_.]*+(?:::[A-Za-z_][A-Za-z0-9_]*+)*+"
             rf"(?:<{_INSIDE}>)?|(?=\[))(?:\[{_INSIDE}\])?[?!]?")
TYPED = re.compile(rf"(?:([A-Za-z_][A-Za-z0-9_.\-]*+)|{_ONE_TYPE}(?:[ \t]*\|[ \t]*{_ONE_TYPE}){{0,9}})[ \t]*=(?![=>])[ \t]*")
TYPE_WORDS = frozenset("str string String bytes Bytes ByteString Text AnyStr Any any object Object unknown Final auto char "
                       "CharSequence SecretStr int float bool boolean number var".split())
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
WORD_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def name_score(name: str) -> int:
    parts = [p.lower() for p in WORD_PARTS.findall(name)]
    best = max((NAME_SCORES.get(p, 0) for p in parts), default=0)
    if any(a in KEY_OWNERS and b in ("key", "keys") for a, b in zip(parts, parts[1:], strict=False)):
        best = max(best, 3)
    return best


def literal_score(value: str) -> int:
    """From -3 (a placeholder or a reference) to 3 (long, mixed, of high entropy)."""
    if len(value) < LEAST_LITERAL:
        return -3
    low = value.lower()
    if value[0] in "$<{%" or any(p in low for p in PLACEHOLDERS):
        return -3
    kinds = sum([any(c.islower() for c in value), any(c.isupper() for c in value),
                 any(c.isdigit() for c in value), any(not c.isalnum() and not c.isspace() for c in value)])
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    spaces = sum(c.isspace() for c in value)
    score = (kinds >= 2) + (kinds >= 3 or any(c.isdigit() for c in value)) + (entropy >= LEAST_ENTROPY)
    return score - 2 * (kinds < 2) - 2 * (spaces > 1)


def suffix_scores(text: str, starts: list[int], end: int) -> dict[int, int]:
    """``literal_score`` of ``text[a:end]`` for every ``a``, in one walk from the end with running counts.

    ``text[min(starts):end]`` has no white space."""
    first = min(starts)
    low, at = [c.lower() for c in text[first:end]], 0
    # the last place where a placeholder starts: later suffixes do not hold it
    joined = "".join(low)
    last = max(joined.rfind(p) for p in PLACEHOLDERS)
    for i, c in enumerate(low):
        if at > last:
            break
        held_from = first + i
        at += len(c)
    out, counts, kinds, bits = {}, {}, [False] * 4, 0.0
    have = lambda c: (c.islower(), c.isupper(), c.isdigit(), not c.isalnum())
    wanted = set(starts)
    for a in range(end - 1, first - 1, -1):
        c = text[a]
        k = counts.get(c, 0)
        if not k:
            for i, yes in enumerate(have(c)):
                kinds[i] |= yes
        counts[c] = k + 1
        bits += (k + 1) * math.log2(k + 1) - (k * math.log2(k) if k else 0.0)
        if a in wanted:
            n, many = end - a, sum(kinds)
            if n < LEAST_LITERAL or c in "$<{%" or (last >= 0 and a <= held_from):
                out[a] = -3
            else:
                entropy = math.log2(n) - bits / n
                out[a] = (many >= 2) + (many >= 3 or kinds[2]) + (entropy >= LEAST_ENTROPY) - 2 * (many < 2)
    return out | {a: -3 for a in starts if a >= end}


def assignments(text: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, whether the value is quoted, start and end of the value) in order.

    Signs inside a bare value are signs too; they share its end, which is looked for once."""
    done = run_end = 0
    for m in SIGN.finditer(text):
        i = m.start()
        if i < done:
            continue
        c, after, before = text[i], text[i + 1:i + 2], text[i - 1:i] if i else ""
        end = i + 1
        if c == ":":
            if after in (":", "/") or before == ":":
                continue
            end += after == "="
        elif after == "=" or before in ("=", "!", "<", ">"):
            continue
        elif after == ">":
            end += 1
        done = end
        at = i
        while at > 0 and text[at - 1] in " \t":
            at -= 1
        if at > 0 and text[at - 1] == "]":
            at -= 1
        if at > 0 and text[at - 1] in "\"'":
            at -= 1
        start = at
        while start > 0 and text[start - 1] in NAME_CHARS:
            start -= 1
        name = NAME.search(text, start, at)
        if not name:
            continue
        v = end
        while v < len(text) and text[v] in " \t":
            v += 1
        typed = TYPED.match(text, v) if c == ":" and end == i + 1 else None
        if typed:
            v = typed.end()
            if typed[1] is None or typed[1] in TYPE_WORDS:
                done = v
        q = QUOTED.get(text[v:v + 1])
        if q:
            value = q.match(text, v)
            if value:
                yield name[0], True, value.start(1), value.end(1)
                if not typed or done == v:
                    done = value.end()
            continue
        if v >= run_end:
            value = BARE.match(text, v)
            if not value:
                continue
            run_end = value.end()
        yield name[0], False, v, run_end


class Constants:
    """What each name of a text is assigned, in order: literals, and names that lead to literals."""

    def __init__(self, text: str, found: list[tuple[str, bool, int, int]]):
        self.indents, line, last = {}, 0, 0
        depth = 0
        for _, _, a, _ in sorted(found, key=lambda x: x[2]):
            at = text.rfind("\n", last, a) + 1
            last = a
            if at > line or not self.indents:
                line, depth = max(at, line), 0
                while text[line + depth:line + depth + 1] in (" ", "\t"):
                    depth += 1
            self.indents[a] = depth
        users: dict[str, list[str]] = {}
        links = [(name, text[a:b], a, b) for name, quoted, a, b in found if not quoted and NAME.fullmatch(text, a, b)]
        self.words = {a: word for _, word, a, _ in links}
        for name, word, _, _ in links:
            users.setdefault(word, []).append(name)
        reach = {name for name, quoted, _, _ in found if quoted}
        todo = list(reach)
        while todo:
            for name in users.get(todo.pop(), []):
                if name not in reach:
                    reach.add(name)
                    todo.append(name)
        self.of: dict[str, list[tuple[int, int, str | None]]] = {}
        for name, a, b, word in sorted([(name, a, b, None) for name, quoted, a, b in found if quoted]
                                       + [(name, a, b, word) for name, word, a, b in links if word in reach],
                                       key=lambda x: x[1]):
            self.of.setdefault(name, []).append((a, b, word))
        self.walked: dict[tuple[int, str, int], int] = {}

    def held(self, word: str, at: int, n: int) -> Iterator[tuple[int, int]]:
        """Literals that ``word`` may hold at a place, without those already given for the same ``n``."""
        todo = [(word, at, self.indents[at])]
        while todo:
            word, at, indent = todo.pop()
            values = self.of.get(word, [])
            before = bisect_left(values, at, key=lambda x: x[0])
            for k in range(before - 1, -1, -1) if before else range(len(values)):
                limit = indent if before else -1
                if self.walked.get((n, word, k), math.inf) <= limit:
                    break
                self.walked[n, word, k] = limit
                a, b, link = values[k]
                if link is None:
                    yield a, b
                else:
                    todo.append((link, a, self.indents[a]))
                if before and self.indents[a] <= indent:
                    break


def lexed_spans(text: str) -> list[Span]:
    found = list(assignments(text))
    constants = None
    out: set[Span] = set()
    scores: dict[str, int] = {}
    bare: dict[int, list[tuple[int, int]]] = {}

    for name, quoted, a, b in found:
        n = scores[name] if name in scores else scores.setdefault(name, name_score(name))
        if not n:
            continue
        if quoted:
            if n + literal_score(text[a:b]) >= LEAST_SCORE:
                out.add(("literal", a, b))
            continue
        constants = constants or Constants(text, found)
        word = constants.words.get(a)
        if word in constants.of:
            for x, y in constants.held(word, a, n):
                if n + literal_score(text[x:y]) >= LEAST_SCORE:
                    out.add(("constant", x, y))
        else:
            bare.setdefault(b, []).append((a, n))
    for b, values in bare.items():  # values of one run have the same end, without closing dots
        end = b
        while end > values[0][0] and text[end - 1] == ".":
            end -= 1
        held = suffix_scores(text, [a for a, _ in values], end)
        out.update(("literal", a, end) for a, n in values if n + held[a] >= LEAST_SCORE)
    return sorted(out)


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text, base ones first kept whole, in the stated order."""
    if not text:
        return []
    spans = base_spans(text)
    if ":" in text or "=" in text:
        starts, ends = [], []  # base spans by start, with the furthest end so far
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            starts.append(a)
            ends.append(max(b, ends[-1] if ends else b))
        for s in lexed_spans(text):
            k = bisect_right(starts, s[1])
            if not k or ends[k - 1] < s[2]:
                spans.append(s)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by ``mask``; null stays null."""
    spans = find_spans(text)
    if not spans:
        return text
    runs: list[list[int]] = []
    for _, a, b in spans:
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    out, at = [], 0
    for a, b in runs:
        out += [text[at:a], mask]
        at = b
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:int,end:int>>"


def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] for t in texts], dtype=object)


def _redacted(texts: pd.Series) -> pd.Series:
    return pd.Series([redact(t) for t in texts], dtype=object)


def scan(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with the spans found in each whole text."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the input has a column named {out}")
    return docs.withColumn(out, F.pandas_udf(_spans, SPANS)(F.col(text)))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced; all rows and columns stay."""
    return docs.withColumn(text, F.pandas_udf(_redacted, "string")(F.col(text)))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

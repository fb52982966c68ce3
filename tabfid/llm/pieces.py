"""SentencePiece BPE encoding by a prefix table, and decoding.

The last piece of the encoding of each prefix of a text is unique.  The table stores it for
every prefix, from left to right: of the pieces that an Aho-Corasick automaton finds ending at
a place, the one that may follow the last piece of the prefix before it.  A pair of pieces may
stand side by side if merging their joined text never merges over their border: the merges of the
two pieces on their own are known, so the test walks along both.  The ids are then read off the
table backwards.  No text is merged; only pairs of pieces are tested, and the tests are kept.

The text is cut where no piece of the model can reach over: before each mark, and between
letters and other characters (checked against all pieces when the model is loaded; a model that
has pieces over such places is not cut).  Encodings of cut parts are kept in a table of bounded
size.

Edge cases: null and empty texts have no ids and decode to the empty text; characters that the
model lacks become their UTF-8 bytes' pieces; repeated rows are encoded alike; columns of the
input pass through untouched and the result column must have a new name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "\u2581"
#: Encodings of text parts kept per Python worker (two generations of so many) and the longest part kept.
MAX_PARTS, MAX_PART_CHARS, MAX_PAIRS = 250_000, 64, 500_000
#: Results go back to Spark in pieces of so many rows or characters, whichever comes first.
ROWS_OUT, CHARS_OUT = 512, 4_000_000
NEVER = float("-inf")


class Pieces:
    """The model's pieces, the automaton over them and the pair tests."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in plain):
            raise ValueError("models with unused pieces are not supported")
        self.n, self.names, self.unknown = n, names, sp.unk_id()
        self.ids = {names[i]: i for i in plain}
        self.score = {names[i]: sp.get_score(i) for i in plain}
        self.bytes = {int(names[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.cut = self._cuts()
        self.letters = {p for p in self.ids if len(p) == 1}
        self.auto = ahocorasick.Automaton()
        self.steps: dict[int, tuple[list[float], list[str], list[str]]] = {}
        for p, i in self.ids.items():
            steps = self._merging(p)
            if steps[1][-1] == p:  # other pieces are never made
                self.steps[i] = steps
                self.auto.add_word(p, (i, len(p)))
        self.auto.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.special = np.zeros(n, bool)
        self.special[[*self.of_byte, *self.silent]] = True

    def _cuts(self) -> re.Pattern | None:
        """Pattern of the parts: no piece reaches from one match into the next."""
        odd: set[str] = set()
        while len(odd) < 50:
            letter = re.compile(r"[^\W\d_" + re.escape("".join(sorted(odd))) + "]")
            kind = {c: 0 if c == MARK else 1 if letter.match(c) else 2 for p in self.ids for c in p}
            over = {c for p in self.ids for x, y in zip(p, p[1:], strict=False)
                    if kind[x] and kind[x] != kind[y] for c in (x, y) if kind[c] == 1}
            if any(kind[x] and not kind[y] for p in self.ids for x, y in zip(p, p[1:], strict=False)):
                return None
            if not over:
                each = letter.pattern
                return re.compile(f"{MARK}*(?:{each}+|(?:(?!{each})[^{MARK}])+)|{MARK}+")
            odd |= over
        return None

    def _merging(self, text: str) -> tuple[list[float], list[str], list[str]]:
        """The text merged on its own, best piece first, of equal ones the leftmost: before each
        merge and at the end, the next merge's score, the first symbol and the last symbol."""
        s, score = list(text), self.score
        nexts, firsts, lasts = [], [], []
        while True:
            best, at = NEVER, -1
            for i in range(len(s) - 1):
                v = score.get(s[i] + s[i + 1], NEVER)
                if v > best:
                    best, at = v, i
            nexts.append(best)
            firsts.append(s[0])
            lasts.append(s[-1])
            if at < 0:
                return nexts, firsts, lasts
            s[at:at + 2] = [s[at] + s[at + 1]]

    def _steps(self, i: int) -> tuple[list[float], list[str], list[str]]:
        if i < self.n:
            return self.steps[i]
        c = chr(i - self.n)
        return [NEVER], [c], [c]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two pieces never merges over their border."""
        (sa, _, ends), (sb, starts, _), score = self._steps(a), self._steps(b), self.score
        i = j = 0
        while True:
            x, y = sa[i], sb[j]
            over = score.get(ends[i] + starts[j])
            if over is not None and over > x and over >= y:
                return False
            if x >= y:
                if x == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def part(self, text: str) -> list[int]:
        """Ids of a text by the prefix table."""
        pairs, m = self.pairs, self.n + 0x110000
        last = [-1] * len(text)
        for end, (i, size) in self._ends(text):
            if last[end] < 0:
                before = end - size
                if before < 0:
                    last[end] = i
                else:
                    key = last[before] * m + i
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) >= MAX_PAIRS:
                            pairs.clear()
                        ok = pairs[key] = self.fits(last[before], i)
                    if ok:
                        last[end] = i
        out: list[int] = []
        at = len(text) - 1
        while at >= 0:
            i = last[at]
            if i < self.n:
                out.append(i)
                at -= len(self.names[i])
                continue
            if self.bytes:
                out.extend(self.bytes[b] for b in reversed(chr(i - self.n).encode("utf-8", "replace")))
            else:
                out.append(self.unknown)
            at -= 1
        return out[::-1]

    def _ends(self, text: str) -> Iterator[tuple[int, tuple[int, int]]]:
        """(last place, (piece, size)) in order of place; a character outside the model stands for itself."""
        if self.letters.issuperset(text):
            return self.auto.iter(text)
        found = list(self.auto.iter(text))
        found += [(k, (self.n + ord(c), 1)) for k, c in enumerate(text) if c not in self.letters]
        return iter(sorted(found))

    def _part(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = np.array(self.part(text), np.int32).tobytes()
        if len(text) <= MAX_PART_CHARS:
            if len(self.young) >= MAX_PARTS:
                self.old, self.young = self.young, {}
            self.young[text] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        text = MARK + text.replace(" ", MARK)
        known = self.young.get
        parts = self.cut.findall(text) if self.cut else [text]
        return np.frombuffer(b"".join([known(p) or self._part(p) for p in parts]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        names, of_byte = self.names, self.of_byte
        if not self.special[ids].any():
            ids = ids.tolist()
            text = "".join(map(names.__getitem__, ids))
        else:
            ids = [i for i in ids.tolist() if i not in self.silent]
            got: list[str] = []
            for raw, run in groupby(ids, of_byte.__contains__):
                got.append(bytes(of_byte[i] for i in run).decode("utf-8", "replace") if raw
                           else "".join([names[i] for i in run]))
            text = "".join(got)
        text = text.replace(MARK, " ")
        return text[1:] if ids and names[ids[0]].startswith(MARK) else text


_loaded: dict[int, Pieces] = {}


def _pieces(model: Broadcast) -> Pieces:
    key = hash(model.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model.value)
    return _loaded[key]


def read_model(spark: SparkSession, path: str) -> Broadcast:
    """The model file's bytes (some hundred KB), for all executors."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def decoded(ids: Column, model: Broadcast) -> Column:
    """string: the text of each id list; null and empty lists give the empty text."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = _pieces(model)
        for lists in batches:
            yield pd.Series(["" if x is None else p.decode(np.asarray(x, np.int32)) for x in lists], dtype=object)
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(ids)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of at most ROWS_OUT rows and, but for single texts, about CHARS_OUT characters."""
    first, got, size = 0, [], 0
    for i, t in enumerate(texts):
        got.append(t.as_py())
        size += len(got[-1] or "")
        if len(got) >= ROWS_OUT or size >= CHARS_OUT:
            yield first, got
            first, got, size = i + 1, [], 0
    if got:
        yield first, got


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids",
                     back: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text (array<int>, without begin and end) in ``ids`` and, if
    asked for, the text decoded from them in ``back``."""
    new = [ids, *([back] if back else [])]
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in new}:
        raise ValueError(f"the input has columns named {sorted(clash)}")
    model = read_model(docs.sparkSession, path)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if back:
        schema = schema.add(back, T.StringType())
    at = docs.columns.index(text)
    names = [*docs.columns, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(model)
        for b in batches:
            for first, texts in _chunks(b.column(at)):
                lists = [p.encode(t) for t in texts]
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                cols = [*b.slice(first, len(texts)).columns,
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))]
                if back:
                    cols.append(pa.array([p.decode(x) for x in lists], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, schema)

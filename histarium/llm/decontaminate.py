"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are normalised alike (ASCII letters lowered, words of
letters and digits). The automaton holds all runs of words of all items. A
document's words are streamed through it; after each word the state tells the
longest run that ends there and also stands in an item. Whenever that run is at
least a window long, or a whole short item ends there, those words are hit.

A word that no item has resets the automaton, so stretches of known words that
are shorter than any window are passed over unread. The automaton is broadcast
and documents are not shuffled. A benchmark of more than ``PART_WORDS`` words is
dealt out to several automata of about that size, one pass over the documents
for each, and what they hit is united: the size of what the driver and a worker
hold is bounded, the benchmark's is not.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, saved
from .words import ALNUM, Words, covered, words

#: Words of a window. Fixed value of the data contract.
WINDOW = 10
#: Documents of which more than this share of the words is hit go as a whole.
MAX_COVERAGE = 0.5
#: Words of the items of one automaton, about 100 bytes each in memory, and of one piece of a long item.
PART_WORDS, PIECE_WORDS = 1_000_000, 100_000
#: The token of a word that no item has.
UNKNOWN = -2


class SuffixAutomaton:
    """All runs of tokens of some sequences, each run with the sequences it stands in.

    Most states have one way out, kept in two arrays; ``more`` has the others.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.token, self.target, self.more = array("q", [-1]), array("q", [0]), {}
        self.link, self.length = array("q", [-1]), array("q", [0])
        of: dict[tuple[int, ...], list[int]] = {}
        self.names: list[str] = []
        for name, tokens in items:
            if tokens:
                of.setdefault(tuple(self.ids.setdefault(w, len(self.ids)) for w in tokens), []).append(len(self.names))
                self.names.append(name)
        self.shortest = min(map(len, of), default=window)
        own: dict[int, list[tuple[int, int]]] = {}
        for path, named in of.items():
            last = 0
            for token in path:
                last = self._extend(last, token)
            if len(path) < window:
                own.setdefault(last, []).extend((len(path), i) for i in named)
        #: The state that holds the last ``window`` tokens of a state's runs.
        self.tail = array("q", bytes(8 * len(self.link)))
        #: (length, item) of the short items that end where a state's runs end.
        self.whole: dict[int, tuple[tuple[int, int], ...]] = {}
        length = np.frombuffer(self.length, np.int64)
        for s in np.argsort(length, kind="stable")[1:].tolist():
            up = self.link[s]
            self.tail[s] = s if self.length[up] < window <= self.length[s] else self.tail[up]
            above = self.whole.get(up, ())
            if s in own or above:
                self.whole[s] = (*own[s], *above) if s in own else above
        #: Items in which the window of a tail state stands: the first, and sets where there are several.
        self.item, self.several = array("q", [-1]) * len(self.link), {}
        for path, named in of.items():
            state = 0
            for i, token in enumerate(path):
                state = self._next(state, token)
                if i + 1 >= window:
                    at = self.tail[state]
                    if self.item[at] < 0:
                        self.item[at] = named[0]
                    if len(named) > 1 or self.item[at] != named[0]:
                        self.several.setdefault(at, {self.item[at]}).update(named)

    def _next(self, state: int, token: int) -> int:
        """The state after a token, or -1."""
        if self.token[state] == token:
            return self.target[state]
        return self.more[state].get(token, -1) if state in self.more else -1

    def _lead(self, state: int, token: int, to: int) -> None:
        if self.token[state] in (-1, token):
            self.token[state], self.target[state] = token, to
        else:
            self.more.setdefault(state, {})[token] = to

    def _add(self, length: int, link: int, like: int = -1) -> int:
        """A new state, with the ways out of state ``like``."""
        new = len(self.link)
        self.link.append(link)
        self.length.append(length)
        self.token.append(-1 if like < 0 else self.token[like])
        self.target.append(0 if like < 0 else self.target[like])
        if like in self.more:
            self.more[new] = dict(self.more[like])
        return new

    def _extend(self, last: int, token: int) -> int:
        """The state of the run of state ``last``, longest form, with ``token`` after it."""
        known = self._next(last, token)
        if known >= 0:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, token, known)
        new, p = self._add(self.length[last] + 1, 0), last
        while p != -1 and (q := self._next(p, token)) < 0:
            self._lead(p, token, new)
            p = self.link[p]
        if p != -1:
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new

    def _split(self, p: int, token: int, q: int) -> int:
        """A state for those runs of ``q`` that are no longer than ``p``'s and the token."""
        half = self._add(self.length[p] + 1, self.link[q], q)
        self.link[q] = half
        while p != -1 and self._next(p, token) == q:
            self._lead(p, token, half)
            p = self.link[p]
        return half

    def scan(self, tokens: list[int]) -> tuple[list[int], list[int], set[str], int]:
        """(places, widths) of the hit runs, the items met, and the longest match."""
        at, width, met, longest = [], [], set(), 0
        state = size = 0
        only, target, more, link, length, whole, window = self.token, self.target, self.more, self.link, self.length, self.whole, self.window
        for i, token in enumerate(tokens):
            while True:
                follow = target[state] if only[state] == token else more[state].get(token, -1) if state in more else -1
                if follow >= 0 or not state:
                    break
                state = link[state]
                size = length[state]
            if follow < 0:
                continue
            state, size = follow, size + 1
            if size > longest:
                longest = size
            if size >= window:
                at.append(i - window + 1)
                width.append(window)
                tail = self.tail[state]
                met.update(self.several.get(tail, (self.item[tail],)))
            for n, item in whole.get(state, ()):
                if n <= size:
                    at.append(i - n + 1)
                    width.append(n)
                    met.add(item)
        return at, width, {self.names[m] for m in met}, longest


#: Of a text: hit or not for each of its words, items met, longest match; None: nothing.
Found = tuple[np.ndarray, set[str], int] | None


class Scanner:
    """The automaton with what finds the stretches of words worth streaming."""

    def __init__(self, automaton: SuffixAutomaton) -> None:
        self.automaton = automaton
        column = pa.array([w.decode() for w in automaton.ids], pa.string())
        found = [w.hashes() for _, _, w in words(column, ALNUM)]
        self.known = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    def scan(self, w: Words) -> list[Found]:
        out: list[Found] = [None] * (len(w.first) - 1)
        if not len(self.known) or not len(w.starts):
            return out
        hashes = w.hashes()
        at = np.searchsorted(self.known, hashes)
        known = self.known[np.minimum(at, len(self.known) - 1)] == hashes
        edge = np.zeros(len(known) + 1, bool)
        edge[w.first] = True
        edge[1:-1] |= known[1:] != known[:-1]
        begins = np.flatnonzero(edge[:-1])
        stops = np.r_[begins[1:], len(known)]
        least = min(self.automaton.shortest, self.automaton.window)
        use = known[begins] & (stops - begins >= least)
        text = np.searchsorted(w.first, begins[use], side="right") - 1
        for t, a, b in zip(text, begins[use], stops[use], strict=True):
            places, widths, met, longest = self.automaton.scan([self.automaton.ids.get(w.word(i), UNKNOWN) for i in range(a, b)])
            hit, had, most = out[t] or (np.zeros(w.first[t + 1] - w.first[t], bool), set(), 0)
            if places:
                hit[a - w.first[t] : b - w.first[t]] |= covered(b - a, np.array(places), np.array(widths))
            out[t] = hit, had | met, max(most, longest)
        return out


def item_pieces(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, part_words: int = PART_WORDS) -> tuple[DataFrame, int]:
    """``part, item, text`` and the number of parts: normalised items, long ones in
    pieces that overlap by a window less one word, dealt out by their text.

    Items without words never match; equal items all count; a null id reads ``null``.
    """
    most = max(min(PIECE_WORDS, part_words), 2 * window)

    def cut(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, _, w in words(batch.column(1), ALNUM, lower=True):
                rows = []
                for t in range(len(w.first) - 1):
                    own = [w.word(i) for i in range(w.first[t], w.first[t + 1])]
                    at = range(0, len(own) - window + 1, most - window + 1) if len(own) > most else [0]
                    rows += [{"item": names[lo + t], "text": b" ".join(own[i : i + most]).decode(), "n": len(own[i : i + most])} for i in at if own]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("item", pa.string()), ("text", pa.string()), ("n", pa.int64())]))

    item = F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null"))
    pieces = saved(benchmark.select(item.alias("item"), F.col(f"`{text_col}`").alias("text")).mapInArrow(cut, "item string, text string, n long"))
    n_parts = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // part_words))
    return pieces.select(F.pmod(F.xxhash64("text"), F.lit(n_parts)).cast("int").alias("part"), "item", "text"), n_parts


def build_scanner(pieces: DataFrame, part: int, window: int = WINDOW) -> Scanner:
    """The automaton of one part, whose items the driver collects."""
    rows = pieces.filter(F.col("part") == part).select("item", "text").collect()
    return Scanner(SuffixAutomaton(((r.item, r.text.encode().split(b" ")) for r in rows), window))


def _keys(text: str) -> list[F.Column]:
    return [F.xxhash64(F.col(f"`{text}`")), F.xxhash64(F.lit(1), F.col(f"`{text}`"), F.lit(2))]


def _hits(docs: DataFrame, text_col: str, scanner: Scanner) -> DataFrame:
    """``k1, k2, edges, items, longest`` of the texts that one automaton hits, each once;
    ``edges``: where runs of hit words begin and end."""
    sent = docs.sparkSession.sparkContext.broadcast(scanner)

    def scan(batches):
        for batch in batches:
            for lo, hi, w in words(batch.column(2), ALNUM, lower=True):
                found = sent.value.scan(w)
                at = [t for t, f in enumerate(found) if f is not None]
                hit = [found[t] for t in at]
                edges = [np.flatnonzero(np.diff(np.r_[False, f[0], False].astype(np.int8))) for f in hit]
                own = batch.slice(lo, hi - lo).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(edges, pa.list_(pa.int64())), pa.array([sorted(f[1]) for f in hit], pa.list_(pa.string())), pa.array([f[2] for f in hit], pa.int64())],
                    names=["k1", "k2", "edges", "items", "longest"],
                )

    k1, k2 = _keys(text_col)
    return docs.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{text_col}`")).mapInArrow(scan, "k1 long, k2 long, edges array<long>, items array<string>, longest long").dropDuplicates(["k1", "k2"])


def _mark(n: int, edges: list[list[int]]) -> np.ndarray:
    hit = np.zeros(n, bool)
    for part in edges:
        for a, b in zip(part[::2], part[1::2], strict=True):
            hit[a:b] = True
    return hit


def _scanned(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, part_words: int, act: Callable[[pa.RecordBatch, Words, list[Found]], Iterator[pa.RecordBatch]], shape) -> DataFrame:
    """What ``act`` makes of each stretch of rows, their words and what the items hit in them."""
    pieces, n_parts = item_pieces(benchmark, item_col, item_text_col, window, part_words)
    where, context = docs.columns.index(text_col), docs.sparkSession.sparkContext
    if n_parts == 1:
        sent = context.broadcast(build_scanner(pieces, 0, window))

        def scan(batches):
            for batch in batches:
                for lo, hi, w in words(batch.column(where), ALNUM, lower=True):
                    yield from act(batch.slice(lo, hi - lo), w, sent.value.scan(w))

        return docs.mapInArrow(scan, shape)
    parts = [saved(_hits(docs, text_col, build_scanner(pieces, p, window))) for p in range(n_parts)]
    united = reduce(DataFrame.unionByName, parts).groupBy("k1", "k2").agg(F.collect_list("edges").alias("edges"), F.collect_list("items").alias("items"), F.max("longest").alias("longest"))
    hits = saved(united)
    discard(*parts)
    k1, k2, hit = (free_name(docs, c) for c in ("_k1", "_k2", "_hit"))
    keyed = docs.withColumns(dict(zip((k1, k2), _keys(text_col), strict=True)))
    held = keyed.join(hits.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.struct("edges", "items", "longest").alias(hit)), [k1, k2], "left").select(*[F.col(f"`{c}`") for c in docs.columns], hit)

    def look(batches):
        for batch in batches:
            for lo, hi, w in words(batch.column(where), ALNUM, lower=True):
                told, n = batch.column(hit).slice(lo, hi - lo).to_pylist(), w.counts().tolist()
                found = [None if h is None else (_mark(m, h["edges"]), set().union(*h["items"]), h["longest"]) for h, m in zip(told, n, strict=True)]
                yield from act(batch.slice(lo, hi - lo).select(list(range(len(batch.columns) - 1))), w, found)

    return held.mapInArrow(look, shape)


def contamination_table(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """``id_col, n_words, n_hit, n_items, items_sha256, contaminated, longest``, a row for each document.

    ``longest`` is the longest run of words shared with an item (a piece of it,
    if it is cut), as far as runs of at least the shortest window were read.
    Null and empty texts have no words; ids are of any type, null ones stay;
    repeated rows give repeated rows; an empty benchmark hits nothing.
    """
    none = sha256(b"").hexdigest()

    def tell(batch, w, found):
        n_hit = np.array([0 if f is None else int(f[0].sum()) for f in found], np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(w.counts(), pa.int64()),
                pa.array(n_hit),
                pa.array([0 if f is None else len(f[1]) for f in found], pa.int64()),
                pa.array([none if f is None else sha256(",".join(sorted(f[1])).encode()).hexdigest() for f in found], pa.string()),
                pa.array(n_hit > 0),
                pa.array([0 if f is None else f[2] for f in found], pa.int64()),
            ],
            names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long"
    return _scanned(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), benchmark, text_col, item_col, item_text_col, window, part_words, tell, shape)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str | None = None, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE, part_words: int = PART_WORDS) -> DataFrame:
    """The documents with hit spans cut out, columns as they were.

    Each run of hit words goes with what stands between them. A document of
    which more than ``max_coverage`` of the words are hit goes as a whole. All
    other documents stay as they are, nulls too. ``length_col``: a column with
    the text's length in characters, set anew where text was cut.
    """
    where = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col else None

    def cut(part, w, found):
        if not any(f is not None and f[0].any() for f in found):
            yield part
            return
        texts, keep = part.column(where).to_pylist(), np.ones(part.num_rows, bool)
        lengths = part.column(length).to_pylist() if length is not None else None
        starts = np.r_[0, np.cumsum([len((t or "").encode()) for t in texts])]
        for t, f in enumerate(found):
            if f is None or not f[0].any():
                continue
            if f[0].sum() > max_coverage * len(f[0]):
                keep[t] = False
                continue
            raw, kept, at = texts[t].encode(), [], 0
            edges = np.flatnonzero(np.diff(np.r_[False, f[0], False].astype(np.int8)))
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                kept.append(raw[at : w.starts[w.first[t] + a] - starts[t]])
                at = w.ends[w.first[t] + b - 1] - starts[t]
            texts[t] = b"".join([*kept, raw[at:]]).decode()
            if lengths is not None:
                lengths[t] = len(texts[t])
        columns = part.columns
        columns[where] = pa.array(texts, part.schema.field(where).type)
        if lengths is not None:
            columns[length] = pa.array(lengths, part.schema.field(length).type)
        yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(keep))

    return _scanned(docs, benchmark, text_col, item_col, item_text_col, window, part_words, cut, T.StructType(docs.schema.fields))

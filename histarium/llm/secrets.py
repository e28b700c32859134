"""Secret scan: fixed patterns, and strings that a primed compressor finds novel.

Besides the base patterns, long strings near words such as ``key`` or ``auth``
are candidates; of one that base spans cut, what is left of it between them. Each is measured by the bytes that it adds when zstd,
primed with a dictionary of identifiers, compresses the text around it: the
compressed size of the surroundings with the candidate, less that of the
surroundings alone. Identifiers, words and repeated values cost little; what
costs most of its own length is reported as ``novel``.

The dictionary is the corpus' own: names that look like code are counted in
Spark by the documents that have them, and the most frequent follow a short list
of usual ones. They are of letters and underscores. Long names that nobody else uses
cost much, too: a string of letters alone must cost more than one with digits, and
change its case as often as random letters do, which names do once in a word.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Base patterns and least lengths. Fixed values of the data contract.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more begins where the run begins
LEAST_VALUE, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "novel")

#: Words that make a context sensitive, and how far ahead of the candidate they may stand.
SENSITIVE = re.compile(r"(?ai)key|secret|token|passw|passwd|pwd|auth|bearer|credential|private|access|signature|session|cookie")
REACH, AROUND = 48, 1024
#: Candidates: with a letter, of this length at least. "=" may stand before one and pads its end.
LEAST_CANDIDATE = 16
BEGIN = re.compile(r"(?a)(?<![\w+/.-])[\w+/.-]{14}")
RUN = re.compile(r"(?a)[\w+/.-]++(?:={1,2}(?![\w+/=.-]))?")
IDENTIFIER, BEHIND = re.compile(r"(?a)\w*+"), re.compile(r"[+/.-]++")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
BETWEEN = "+/.-"  # goes from the end of a candidate at which a base span was cut out
#: Added bytes for each byte of a candidate from which it counts as incompressible. Random hex adds about 0.55.
NOVELTY = 0.45
#: The same for strings without a digit: names of several rare words add 0.5 to 0.75, random letters of both cases 0.75 to 1.
NOVELTY_LETTERS = 0.65
#: Words of a name, and the mean length from which a string of letters is taken for one. Those of random letters have 2.7.
NAME_PART, LEAST_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), 4
#: Names that look like code: of several parts, or right before what assigns, calls or indexes.
NAME = r"(?<![A-Za-z0-9_])(?:[A-Za-z]{2,24}+_[A-Za-z_]{1,40}+|[a-z]{2,24}+[A-Z][A-Za-z]{1,40}+|[A-Za-z]{4,32}+(?=[=:(\[]))(?![A-Za-z0-9_])"
#: Names in the dictionary at most, and documents that must have one. Names are under 70 bytes, so the dictionary is small.
MOST_NAMES, LEAST_DOCUMENTS = 2000, 3
#: Usual names, for corpora that have few.
IDENTIFIERS = """
access_key access_token accountId algorithm api_key apikey application/json args async authorization Authorization: Basic
aws_access_key_id aws_secret_access_key base64 Bearer boolean certificate class client_id client_secret client const
Content-Type: context cookie createElement credential credentials database default def default_value description encoding
environment exception export false function getElementById hostname http:// https:// import index instance integer
interface key_id length localhost localStorage message method module namespace None null number object options
override package parameter password passwd private_key private static public_key public refresh_token request response
return secret secret_key self session session_id setAttribute signature string super this timestamp token true
undefined user_id username utf-8 value version void www.example.com xml yaml configuration 0123456789abcdef
"""


def corpus_identifiers(docs: DataFrame, text_col: str = "text", most: int = MOST_NAMES) -> list[str]:
    """The names that most documents have, the most frequent last, where they prime best.

    Counted over all documents; the driver gets ``most`` rows.
    """
    names = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(NAME), F.lit(0)))).alias("name"))
    counted = names.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCUMENTS)
    return [r.name for r in counted.orderBy(F.desc("n"), "name").limit(most).collect()][::-1]


class Novelty:
    """Marginal compressed bytes of a string in its surroundings."""

    def __init__(self, identifiers: Sequence[str] = ()) -> None:
        words = zstandard.ZstdCompressionDict(" ".join([*IDENTIFIERS.split(), *identifiers]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=9)
        self.zip = zstandard.ZstdCompressor(level=9, dict_data=words)

    def added(self, text: str, start: int, end: int) -> float:
        """Added bytes for each byte of ``text[start:end]``."""
        before, own, after = text[max(0, start - AROUND) : start].encode(), text[start:end].encode(), text[end : end + AROUND].encode()
        around = before + after
        return (len(self.zip.compress(around + own)) - len(self.zip.compress(around))) / len(own)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of strings, whole: those that begin within ``REACH`` after
    a sensitive word, and what follows the first and the last sensitive identifier
    inside a string (``key-...``, ``auth/...``). Strings are read once, so this is linear."""
    found: dict[int, int] = {}
    inner: dict[int, tuple[int, int]] = {}  # by the end of the string
    name = upto = 0  # ends of the last identifier and string
    for s in SENSITIVE.finditer(text):
        for m in BEGIN.finditer(text, s.end(), min(len(text), s.end() + REACH + 14)):
            if m.start() not in found:
                found[m.start()] = RUN.match(text, m.start()).end()
        if s.end() > name:
            name = IDENTIFIER.match(text, s.end()).end()
            if behind := BEHIND.match(text, name):
                start = behind.end()
                if start >= upto and (m := RUN.match(text, start)):
                    upto = m.end()
                if start < upto:
                    inner[upto] = (inner.get(upto, (start,))[0], start)
    for end, starts in inner.items():
        found |= dict.fromkeys(starts, end)
    return sorted((a, b) for a, b in found.items() if b - a >= LEAST_CANDIDATE and LETTER.search(text, a, b))


def rests(text: str, start: int, end: int, base: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of a candidate between ``base`` spans, which are apart and in order, where it can be a candidate still."""
    i = bisect_right(base, start, key=lambda s: s[1])
    at, cut = start, False
    while True:
        hit = i < len(base) and base[i][0] < end
        upto = max(at, base[i][0]) if hit else end
        own = text[at:upto]
        a, b = at + (len(own) - len(own.lstrip(BETWEEN)) if cut else 0), upto - (len(own) - len(own.rstrip(BETWEEN)) if hit else 0)
        if b - a >= LEAST_CANDIDATE and LETTER.search(text, a, b):
            yield a, b
        if not hit:
            return
        at, cut, i = base[i][1], True, i + 1
        if at >= end:
            return


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The places that spans cover, as spans that are apart."""
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def find_secrets(text: str | None, novelty: Novelty) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each span, in order, by code points."""
    raw = (text or "").encode()
    low = raw.lower()  # bytes: ASCII letters only
    spans: list[tuple[int, int, int]] = []
    if any(w in low for w in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text or "")]
    if any(w in low for w in (b"key", b"secret", b"token", b"passw", b"passwd", b"pwd", b"auth", b"bearer", b"credential", b"private", b"access", b"signature", b"session", b"cookie")):
        base, until = _apart(spans), 0  # and the end of the last novel string
        for whole in candidates(text):  # neither starts nor ends descend
            for start, end in rests(text, *whole, base):
                digits = DIGIT.search(text, start, end)
                if not digits and sum(map(len, parts := NAME_PART.findall(text, start, end))) >= LEAST_PART * len(parts):
                    continue
                least = NOVELTY if digits else NOVELTY_LETTERS
                if start >= until and novelty.added(text, start, end) >= least:
                    spans.append((start, 3, end))
                    until = end
    return sorted(spans)


def _told(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers: Sequence[str] | None = None) -> DataFrame:
    """``id_col, n_assign, n_access, n_hex, n_novel, base_sha256, spans``, a row for each row of ``docs``.

    Null and empty texts have no spans (``spans`` is then an empty string);
    a span found by two base patterns is told twice; repeated rows give repeated
    rows; ids are of any type; texts are scanned whole, whatever their length.
    ``identifiers``: for the dictionary, those of ``docs`` unless given.
    """
    identifiers = corpus_identifiers(docs, text_col) if identifiers is None else identifiers

    def scan(batches):
        novelty = Novelty(identifiers)
        for batch in batches:
            found = [find_secrets(t, novelty) for t in batch.column(1).to_pylist()]
            base = [[s for s in f if s[1] < 3] for f in found]
            count = [pa.array([sum(s[1] == k for s in f) for f in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *count, pa.array([sha256(_told(b).encode()).hexdigest() for b in base], pa.string()), pa.array(map(_told, found), pa.string())],
                names=[id_col, "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(scan, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", identifiers: Sequence[str] | None = None) -> DataFrame:
    """The documents with each span, or run of spans that overlap, replaced by ``mark``."""
    where = docs.columns.index(text_col)
    identifiers = corpus_identifiers(docs, text_col) if identifiers is None else identifiers

    def redact(batches):
        novelty = Novelty(identifiers)
        for batch in batches:
            texts = batch.column(where).to_pylist()
            for t, text in enumerate(texts):
                out, at = [], 0
                for a, _, b in find_secrets(text, novelty):
                    if a >= at:
                        out += [text[at:a], mark]
                    at = max(at, b)
                if at:
                    texts[t] = "".join([*out, text[at:]])
            columns = batch.columns
            columns[where] = pa.array(texts, batch.schema.field(where).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(redact, T.StructType(docs.schema.fields))

"""Personal data: patterns, and the terms that corpus co-occurrence shows to reveal protected entities."""

from __future__ import annotations

import hashlib
import math
import re
import string
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, spare_names

KINDS = ("email", "ip", "card", "phone", "secret", "term")
#: The kinds whose patterns are given; secrets and terms are the method's own.
BASE_KINDS = 4
#: An address is found by its sign and then matched outwards, a network address from the first digit of a run only:
#: the leftmost matches are the same, and a long run of one class costs its length and not the square of it.
_MAIL_SIGNS = string.ascii_letters + string.digits + "._%+-"
_MAIL_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SECRET = re.compile(r"[A-Za-z0-9_+=-]{24,}")
_TERM = re.compile(r"[^\W\d_]{2,}")

#: Characters on either side of an entity in which a term counts as co-occurring with it.
WINDOW = 80
#: Different surroundings in which an entity and a term must meet, and the share of a term's occurrences.
SUPPORT = 3
SHARE = 0.5
#: Bits that all surroundings together must tell of a group of entities: chance gives a term so many once in 2 to that power.
EVIDENCE = 30
#: Bits a character and least letters and digits of a secret: random hexadecimal digits have close to 4, words hardly a digit.
SECRET_BITS = 3.0
SECRET_SIGNS = 4
#: Size of the bit map that screens terms before the exact join: its size is fixed, its precision isn't needed.
SCREEN = 1 << 22


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mail_spans(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, leftmost and not overlapping: a local part holds no sign, so it lies between two of them."""
    low, sign = 0, text.find("@")
    while sign >= 0:
        start, host = low + len(text[low:sign].rstrip(_MAIL_SIGNS)), _MAIL_HOST.match(text, sign)
        found = host is not None and start < sign
        if found:
            yield start, host.end()
        low = host.end() if found else sign + 1
        sign = text.find("@", sign + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start, in code points; leftmost, not overlapping within a kind."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(0, start, end) for start, end in mail_spans(text)]
    if not _DIGIT.search(text):
        return found
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((3, *m.span()))
    return found


def cover(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, in order, none overlapping."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted((s, e) for _, s, e in spans):
        if starts and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def within(covered: tuple[list[int], list[int]], low: int, high: int) -> Iterator[tuple[int, int]]:
    """What ``covered`` has of the stretch from ``low`` to ``high``."""
    starts, ends = covered
    for i in range(bisect_right(ends, low), len(starts)):
        if starts[i] >= high:
            return
        yield max(low, starts[i]), min(high, ends[i])


def secret_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Keys and tokens: long runs of letters and digits too random to be words, outside the spans ``taken``."""
    out, covered = [], cover(taken)
    for m in _SECRET.finditer(text):
        digits, letters = sum(c.isdigit() for c in m[0]), sum(c.isalpha() for c in m[0])
        if min(digits, letters) < SECRET_SIGNS or next(within(covered, *m.span()), None):
            continue
        n = len(m[0])
        if -sum(k / n * math.log2(k / n) for k in Counter(m[0]).values()) >= SECRET_BITS:
            out.append((KINDS.index("secret"), *m.span()))
    return out


def groups_of(kind: int, value: str) -> list[str]:
    """What an entity belongs to: its kind, and an address's host, network or prefix."""
    digits = "".join(c for c in value if c.isdigit())
    part = {0: value.rsplit("@", 1)[-1], 1: ".".join(value.split(".")[:2]), 2: digits[:6], 3: digits[:6]}.get(kind)
    return [f"{KINDS[kind]}", *([f"{KINDS[kind]} {part}"] if part else [])]


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def surroundings(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """For each span: the hashes of the entity and of its groups, the terms near it (itself and other spans left out), and a hash of these.

    A window that ends within a word goes on to the word's end.
    """
    out, covered = [], cover(spans)
    for kind, start, end in spans:
        low, high = max(0, start - WINDOW), min(len(text), end + WINDOW)
        while low and text[low - 1].isalpha() and text[low].isalpha():
            low -= 1
        while high < len(text) and text[high].isalpha() and text[high - 1].isalpha():
            high += 1
        chars, base = list(text[low:high]), low
        for s, e in within(covered, low, high):
            chars[s - base : e - base] = " " * (e - s)
        terms = sorted({t.lower() for t in _TERM.findall("".join(chars))})
        if terms:
            value = text[start:end].lower()
            out.append({"entity": _digest(f"{KINDS[kind]}:{value}"), "groups": [_digest(g) for g in groups_of(kind, value)], "context": _digest(" ".join(terms)), "terms": terms})
    return out


def screen_bit(term: str) -> int:
    return zlib.crc32(term.encode()) % SCREEN


def _screen(terms: DataFrame) -> np.ndarray:
    """A bit map of the terms' checksums. Reaches the driver as words of 64 bits: at most SCREEN / 64 rows."""
    bit = (F.crc32(F.col("term").cast("binary")) % SCREEN).alias("bit")
    words = terms.select(bit).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    out = np.zeros(SCREEN // 64, np.int64)
    for at, word in words.collect():
        out[at] = word
    return np.packbits(np.unpackbits(out.view(np.uint8), bitorder="little"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(F.col(key).alias("doc"), F.xxhash64(body).alias("text_hash"), body.alias("body"))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_hash, spans, near) for every row: the pattern spans and what surrounds them."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [b or "" for b in batch.column(2).to_pylist()]
            spans = [base_spans(b) for b in bodies]
            spans = [found + secret_spans(b, found) for b, found in zip(bodies, spans, strict=True)]
            near = [surroundings(b, s) if s else [] for b, s in zip(bodies, spans, strict=True)]
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in found] for found in spans]
            span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            around = pa.list_(pa.struct([("entity", pa.int64()), ("groups", pa.list_(pa.int64())), ("context", pa.int64()), ("terms", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, span), pa.array(near, around)], ["doc", "text_hash", "spans", "near"])

    kind = docs.schema[key].dataType.simpleString()
    return _rows(docs, key, text).mapInArrow(run, f"doc {kind}, text_hash long, spans array<struct<kind: int, start: int, end: int>>, near array<struct<entity: long, groups: array<long>, context: long, terms: array<string>>>")


def revealing_terms(docs: DataFrame, found: DataFrame, text: str = "text", support: int = SUPPORT, share: float = SHARE, evidence: float = EVIDENCE) -> DataFrame:
    """(term) whose occurrences disclose an entity or a group of entities.

    Protected are single entities and groups of them: all of a kind, those of one mail host, network, card
    issuer or area code. For a term t and an entity or group e, P(e|t) is the share of t's occurrences in the
    whole corpus that stand near e, P(e) that of all words. t reveals e if they meet in at least ``support``
    different surroundings and P(e|t) >= ``share``; for a group, which is large, the surroundings must also tell
    ``evidence`` bits of it in all, each log2(P(e|t) / P(e)). How frequent a single entity is doesn't matter: its
    gain is at most -log2 P(e), so a least gain would hide every term of a frequent one. Copies of one
    passage are one surrounding. Counts cover all documents; a bit map of fixed size only screens which words are counted.
    """
    windows = found.select(F.explode("near").alias("w")).select("w.*")
    whole = F.transform("groups", lambda g: F.struct(g.alias("entity"), F.lit(True).alias("group")))
    windows = windows.select(F.explode(F.concat(F.array(F.struct("entity", F.lit(False).alias("group"))), whole)).alias("e"), "context", "terms").select("e.*", "context", "terms")
    near = windows.groupBy("entity").agg(F.sum(F.size("terms")).alias("near"))
    met = windows.select("entity", "group", "context", F.explode("terms").alias("term")).groupBy("entity", "group", "term", "context").agg(F.count("*").alias("n"))
    met = materialise(met.groupBy("entity", "group", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("joint")).where(F.col("contexts") >= support), "met")
    screen = docs.sparkSession.sparkContext.broadcast(_screen(met))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit_map, counts, total = np.unpackbits(screen.value).astype(bool), Counter(), 0

        def flush(last: bool) -> pa.RecordBatch:
            kept = [(t, n) for t, n in counts.items() if bit_map[screen_bit(t)]] + [(None, total)] * last
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["term", "n"])

        for batch in batches:
            for body in batch.column(0).to_pylist():
                words = _TERM.findall((body or "").lower())
                counts.update(words)
                total += len(words)
            if len(counts) > 300_000:
                yield flush(False)
        yield flush(True)

    counted = docs.select(F.col(text).cast("string")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("times"))
    counted = materialise(counted, "term-counts")  # the row of no term is the number of all words
    words = counted.where("term is null").select(F.col("times").alias("words"))
    tied = met.join(counted, "term").join(near, "entity").crossJoin(words)  # one row
    given = F.least(F.col("joint") / F.col("times"), F.lit(1.0))
    told = F.col("contexts") * F.log2(given / F.least(F.col("near") / F.col("words"), F.lit(1.0)))
    return tied.where(given >= share).where(~F.col("group") | (told >= evidence)).select("term").distinct()


def term_spans(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_hash, term_spans): where the terms stand, in every document."""
    screen = docs.sparkSession.sparkContext.broadcast(_screen(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit_map = np.unpackbits(screen.value).astype(bool)
        memo: dict[str, bool] = {}
        for batch in batches:
            rows = []
            for i, body in enumerate(batch.column(2).to_pylist()):
                if not body:
                    continue
                if len(memo) > 300_000:
                    memo.clear()
                hit = False
                for t in set(_TERM.findall(body)):
                    if t not in memo:
                        memo[t] = bool(bit_map[screen_bit(t.lower())])
                    hit = hit or memo[t]
                if hit:
                    rows += [(i, m[0].lower(), *m.span()) for m in _TERM.finditer(body) if memo[m[0]]]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())], ["doc", "text_hash", "term", "start", "end"])

    kind = docs.schema[key].dataType.simpleString()
    places = _rows(docs, key, text).mapInArrow(run, f"doc {kind}, text_hash long, term string, start int, end int").join(terms, "term", "left_semi")
    return places.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set(F.struct(F.lit(KINDS.index("term")).alias("kind"), "start", "end"))).alias("term_spans"))


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """(key, text_hash, base, spans) for every row, both arrays of (kind, start, end) in code points.

    ``base`` has the given patterns' spans, ``spans`` these, secrets' and the revealing terms'. Null texts count as empty;
    rows that repeat key and text get the same spans; an empty table gives an empty result; other
    columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    found = materialise(detect(docs, key, text), "pattern-spans")
    terms = materialise(revealing_terms(docs, found, text, support, share), "revealing-terms")
    base = found.select("doc", "text_hash", "spans")
    if terms.limit(1).count():
        more = term_spans(docs, terms, key, text).withColumnsRenamed({"doc": "_doc", "text_hash": "_hash"})
        base = base.join(more, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
        both = F.when(F.col("term_spans").isNull(), F.col("spans")).otherwise(F.concat("spans", "term_spans"))
    else:
        both = F.col("spans")
    given = F.filter("spans", lambda s: s["kind"] < BASE_KINDS)
    return base.select(F.col("doc").alias(key), "text_hash", given.alias("base"), both.alias("spans"))


def _joined(spans: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row."""
    spans = find_spans(docs, key, text)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return spans.select(key, *[count(k) for k in range(BASE_KINDS)], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def generalise(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first to start names them all."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text of every row generalised, columns as they were, whatever their names. Null texts stay null."""
    spans = find_spans(docs, key, text).where(F.size("spans") > 0).dropDuplicates([key, "text_hash"])
    doc, hashed, found = spare_names(docs, "doc", "hash", "spans")
    spans = spans.select(F.col(key).alias(doc), F.col("text_hash").alias(hashed), F.col("spans").alias(found))
    body = F.col(text).cast("string")
    both = docs.join(spans, F.col(key).eqNullSafe(F.col(doc)) & (F.xxhash64(body) == F.col(hashed)), "left").drop(doc, hashed)
    at = both.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, found = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            texts = [generalise(b, [(s["kind"], s["start"], s["end"]) for s in f]) if f and b is not None else b for b, f in zip(bodies, found, strict=True)]
            cols = [*batch.columns[:at], pa.array(texts, batch.schema.field(at).type), *batch.columns[at + 1 : -1]]
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    return both.mapInArrow(run, docs.schema)


def digest(spans: list[tuple[int, int, int]]) -> str:
    """The base digest of one text, as ``report`` gives it."""
    return hashlib.sha256(render(spans).encode()).hexdigest()

"""Personal data: pattern spans, and terms that give their holders away.

Patterns find the protected entities (email, ip, card, phone).  The corpus then tells how much a term near an entity
says about it.  With N documents, c(e) the distinct contexts of an entity, c(t, e) those that hold the term and d(t)
the documents that hold it anywhere, the entity's share among the term's documents is estimated as
``p = (c(t,e) + s c(e) / N) / (d(t) + s)``: ``shrink`` (s) documents count as the whole corpus, so that few occurrences
tell less.  The term discloses ``log2(p N / c(e)) / log2(N / c(e))`` of the entity's information content.  From
``generalise_from`` on its occurrences in documents with that entity are generalised, from ``remove_from`` on removed.
Every term beside an entity is judged, also beside one that occurs once.  A context counts once however often it is
copied.

Passes over the texts: contexts of the entities; document counts of the terms in them (a filter of bounded size says
which these may be); the spans.  Only documents that hold a disclosing term travel.

Defined results: a null text counts as empty and has no spans; repeated rows each get a row; a null id is a document
whose terms are never changed (its pattern spans are); failing pattern matches are dropped without another try; further
columns are ignored (``sanitized`` keeps them, whatever their names); an empty table gives no rows.  Terms are words of
three letters and more without digits, among the ten and the 400 characters on either side of an entity.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import Shared, filter_bits, map_batches, mix, slices, texts_of, tidy
from gristmill.session import stage

KINDS = ("email", "ip", "card", "phone")
# The patterns of the four kinds.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that fails at the first digit of a run fails at its other digits, so only first digits are tried.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_TERM = re.compile(r"[^\W\d_]{3,}")
# A context: so many terms on either side, within so many characters.
TERMS_BESIDE, CHARS_BESIDE = 10, 400
FILTER_BITS = (1 << 23, 1 << 29)


def _emails(text: str):
    at, used = text.find("@"), 0
    while at >= 0:
        own = text[used:at]
        start = used + len(own.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            used = m.end()
        # A local part holds no "@", so the next one begins after this.
        used = max(used, at + 1)
        at = text.find("@", used)


def _luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    total += sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(map(_small, m.groups())):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def _value(kind: str, found: str) -> str:
    return kind + ":" + (found.lower() if kind in ("email", "ip") else "".join(c for c in found if c.isdigit()))


def contexts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``entity``, ``context`` (a hash), ``terms`` for every pattern span."""

    def step(piece):
        out = []
        for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
            spans = base_spans(text)
            for kind, start, end in spans:
                near = [(s, e) for _, s, e in spans if s < end + CHARS_BESIDE and e > start - CHARS_BESIDE]

                def beside(lo: int, hi: int) -> str:
                    part = list(text[lo:hi])
                    for s, e in near:
                        for k in range(max(s, lo), min(e, hi)):
                            part[k - lo] = " "
                    return "".join(part).lower()

                left = _TERM.findall(beside(max(0, start - CHARS_BESIDE), start))[-TERMS_BESIDE:]
                right = _TERM.findall(beside(end, min(len(text), end + CHARS_BESIDE)))[:TERMS_BESIDE]
                code = hashlib.blake2b(" ".join([*left, "|", *right]).encode(), digest_size=8).digest()
                out.append((doc, _value(kind, text[start:end]), int.from_bytes(code, "little", signed=True), sorted({*left, *right})))
        if out:
            doc, entity, context, terms = zip(*out)
            yield {"doc_id": doc, "entity": entity, "context": context, "terms": pa.array(terms, pa.list_(pa.string()))}

    return map_batches(docs, "doc_id long, entity string, context long, terms array<string>", step)


def _term_places(terms: list[str], size: int) -> np.ndarray:
    codes = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") for t in terms]
    return (mix(np.array(codes, np.uint64)) % np.uint64(size)).astype(np.int64)


def filter_of(places_of, column: DataFrame) -> np.ndarray:
    """A bit for every value's hash, sized by ``filter_bits`` of their number."""
    size = filter_bits(column.count(), FILTER_BITS)

    @tidy
    def run(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = places_of(batch.column(0).to_pylist(), size)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bits[used].astype(np.int32))], names=["byte", "bits"])

    rows = column.mapInArrow(run, "byte long, bits int").groupBy("byte").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 8, np.uint8)
    bits[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy()
    return bits


def _hits(bits: np.ndarray, places_of, values: list) -> np.ndarray:
    places = places_of(values, len(bits) * 8)
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


def _id_places(ids: list, size: int) -> np.ndarray:
    return (mix(np.array([i or 0 for i in ids], np.int64).view(np.uint64)) % np.uint64(size)).astype(np.int64)


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term``, ``n_docs`` of the given terms over all texts; a task adds up its documents before anything moves."""
    bits = filter_of(_term_places, terms)
    none, shared = not bits.any(), Shared(docs.sparkSession, bits)

    @tidy
    def run(batches):
        counts: dict[str, int] = {}
        wanted: dict[str, bool] = {}
        for batch in batches:
            for piece in () if none else slices(batch):
                for text in piece.column("text").to_pylist():
                    words = set(_TERM.findall(text.lower()))
                    new = [w for w in words if w not in wanted]
                    if new:
                        wanted.update(zip(new, _hits(shared.value, _term_places, new).tolist()))
                    for w in words:
                        if wanted[w]:
                            counts[w] = counts.get(w, 0) + 1
                    if len(wanted) > 150_000:
                        wanted.clear()
                    if len(counts) > 150_000:
                        yield listed(counts)
                        counts.clear()
        yield listed(counts)

    def listed(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_docs"))
    return counted.join(terms.select(F.col(terms.columns[0]).alias("term")).distinct(), "term", "left_semi")


def disclosures(docs: DataFrame, found: DataFrame, generalise_from: float, shrink: float) -> DataFrame:
    """``entity``, ``term``, ``disclosure`` of the terms that tell too much."""
    n = docs.count()
    total = found.select("entity", "context").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("c_e"))
    near = found.select("entity", "context", F.explode("terms").alias("term")).distinct()
    near = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("c_te"))
    near = stage(near, "near")
    counts = document_counts(docs, near.select("term").distinct())
    joined = near.join(counts, "term").join(total, "entity")
    content = F.log2(F.lit(float(n)) / F.col("c_e"))
    rate = (F.col("c_te") + F.lit(float(shrink)) * F.col("c_e") / F.lit(float(max(n, 1)))) / (F.col("n_docs") + F.lit(float(shrink)))
    shared = F.log2(F.lit(float(n)) * rate / F.col("c_e"))
    share = F.when(content > 0, F.least(shared / content, F.lit(1.0))).otherwise(F.lit(0.0))
    return joined.select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= generalise_from)


def spans_with_terms(text: str, terms: dict[str, float]) -> list[tuple[str, int, int]]:
    """Pattern spans, then the terms' occurrences outside them."""
    spans = base_spans(text)
    if terms:
        taken = sorted((s, e) for _, s, e in spans)
        reach, ends = 0, []
        for _, e in taken:
            reach = max(reach, e)
            ends.append(reach)
        starts = [s for s, _ in taken]
        for m in _TERM.finditer(text):
            if m.group().lower() in terms:
                k = bisect_right(starts, m.end() - 1)
                if k == 0 or ends[k - 1] <= m.start():
                    spans.append(("term", *m.span()))
    return spans


def scan(docs: DataFrame, finish, schema: str, generalise_from: float = 0.8, shrink: float = 1.0) -> DataFrame:
    """``finish(row, spans, terms)`` gives the values of ``schema`` for every row (a dict of the columns of ``docs``)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    plain = texts_of(docs)
    docs = texts_of(docs, F.struct("*").alias("row"))
    found = stage(contexts(plain), "contexts")
    telling = disclosures(plain, found, generalise_from, shrink)
    changed = found.select("doc_id", "entity").where("doc_id is not null").distinct().join(telling, "entity")
    changed = changed.groupBy("doc_id", "term").agg(F.max("disclosure").alias("disclosure"))
    changed = changed.groupBy(F.col("doc_id").alias("of_doc")).agg(F.collect_list("term").alias("terms"), F.collect_list("disclosure").alias("shares"))
    changed = stage(changed, "changed")
    bits = Shared(docs.sparkSession, filter_of(_id_places, changed.select("of_doc")))

    def kept(batch, inside: bool):
        return batch.filter(pa.array(_hits(bits.value, _id_places, batch.column("doc_id").to_pylist()) == inside))

    @tidy
    def chosen(batches):
        for batch in batches:
            yield kept(batch, True)

    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def finished(whole: bool):
        """A task's function; of whole tables it takes the rows without terms, by itself: a worker for that alone would
        stand beside each task's other one, and stay in memory for the rest of the application."""

        @tidy
        def run(batches):
            for batch in batches:
                for piece in slices(kept(batch, False) if whole else batch):
                    out = []
                    for one in piece.to_pylist():
                        terms = dict(zip(one.get("terms") or [], one.get("shares") or []))
                        out.append(finish(one["row"], spans_with_terms(one["text"], terms), terms))
                    columns = list(zip(*out)) if out else [[] for _ in arrow]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        return run

    # Not a broadcast join, also with few rows: what follows the shuffle is a stage of its own, where the next worker stands alone.
    inside = docs.mapInArrow(chosen, docs.schema).join(changed.hint("merge"), F.col("doc_id") == F.col("of_doc"), "left").drop("of_doc")
    return docs.mapInArrow(finished(True), schema).union(inside.mapInArrow(finished(False), schema))


def _listed(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def span_digests(docs: DataFrame) -> DataFrame:
    """Counts of the kinds, a digest of the pattern spans, and all spans of every document."""

    def finish(row, spans, _):
        base = [x for x in spans if x[0] != "term"]
        counts = [sum(x[0] == k for x in base) for k in KINDS]
        return row["doc_id"], *counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return scan(docs.select("doc_id", "text"), finish, schema)


def masked(text: str, spans, terms: dict[str, float], remove_from: float) -> str:
    """The text with every span replaced; where spans overlap, the first stands for all."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start < at:
            at = max(at, end)
            continue
        gone = kind == "term" and terms[text[start:end].lower()] >= remove_from
        out += [text[at:start], "" if gone else f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def sanitized(docs: DataFrame, remove_from: float = 0.95, generalise_from: float = 0.8, shrink: float = 1.0) -> DataFrame:
    """``docs`` with the same columns and masked texts; ``n_chars`` follows the text where there is one."""
    names = docs.columns

    def finish(row, spans, terms):
        if spans:
            row["text"] = masked(row["text"], spans, terms, remove_from)
            if row.get("n_chars") is not None:
                row["n_chars"] = len(row["text"])
        return tuple(row[c] for c in names)

    return scan(docs, finish, docs.schema, generalise_from, shrink)

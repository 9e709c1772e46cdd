"""Personal data: fixed patterns, and terms that give a protected value away by information theory.

Base kinds (email, ip, card, phone) are found by pattern and check. Each value found is a protected entity. A term (a run of letters of any length) in a document of an entity discloses it as
far as the term's pointwise mutual information with the entity reaches the entity's information content (Sánchez & Batet's C-sanitisation): from ``generalise`` of it on the term is
generalised, from ``remove`` on it is removed, wherever it stands in a document that holds the entity. Generalised means replaced by the class of all terms with the same beginning, of the longest beginning
(3 letters at most) whose class stays below the threshold by the same measure, and by a class of all terms where none does. All counts are of documents over the whole corpus, copies included: with the entity, with
the term, with both; letters inside base spans are no terms. A pair needs two documents, since one co-occurrence estimates nothing: the terms of a value of one document only stay undecided.

Scale: entities of the same documents are one profile. Pairs of profile and term are counted first, pre-aggregated, over texts that hold an entity of two documents or more, and only for terms that are rare
enough among the documents with entities to tell of one (an exact bound, which the common words of a text do not pass); documents are then counted, in one pass, only for the terms of pairs with two documents, and for their classes, by broadcast filter while these are at most ``broadcast_terms``, else by a join. Only texts with disclosing terms are shuffled to be rewritten, or all where more than ``broadcast_terms`` have some. The lists belong to a text, so copies share them.

Defined cases: null and empty texts have no spans; offsets count code points, ends are exclusive; repeated rows give repeated results and are one document as evidence; spans of different kinds may
overlap, and are merged when a text is rewritten (the earliest names the merged one). Extra columns are kept by ``sanitise``; tables
may be empty; ids must be numbers.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, released, scratch, stored, text_key

KINDS = ("email", "ip", "card", "phone")
#: Lengths of the beginnings that name classes of terms.
BEGINNINGS = (1, 2, 3)
#: Tasks of the pass that counts documents, for each core; counts that a task holds before it hands them on, and terms whose names it keeps.
TASKS_A_CORE, HELD, KNOWN = 4, 100_000, 20_000
#: The disclosing terms of a text.
TERMS = "array<struct<term:string,removed:boolean,class:string>>"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_NUMBER = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """At each sign the longest local part before it that no earlier match has used; linear, whatever the text."""
    last, at = 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        begin = at
        if found:
            while begin > last and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at:
                last = found.end()
                yield begin, last
        at = text.find("@", max(at + 1, last))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Dotted runs of numbers, four at a time from the left."""
    for run in _DOTTED.finditer(text):
        parts = list(_NUM.finditer(text, run.start(), run.end()))
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0][-3:]) <= 255 for p in four):
                yield four[0].start(), four[3].end()


_NUM = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_NUM.findall(text))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of base spans, by kind as in KINDS, then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", a, b) for a, b in _ips(text)]
        for m in _NUMBER.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity(kind: str, value: str) -> str:
    """A protected value as a hash: the tables in between hold no personal data."""
    plain = value.lower() if kind == "email" else value if kind == "ip" else _digits(value)
    return hashlib.sha256(f"{kind}:{plain}".encode()).hexdigest()


def places(text: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """The terms of a text outside of all base spans."""
    taken, i, reached = sorted((a, b) for _, a, b in spans), 0, 0
    for m in _TERM.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            reached = max(reached, taken[i][1])
            i += 1
        if m.start() >= reached:
            yield m


def term_set(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    return {x.lower() for x in ({m[0] for m in places(text, spans)} if spans else set(_TERM.findall(text)))}


def found(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, entities, terms: one row a document that holds an entity."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("entities", pa.list_(pa.string())), ("terms", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for doc_id, key, text in zip(*batch.columns, strict=True):
                text = text.as_py()
                if spans := base_spans(text):
                    held.append((doc_id.as_py(), key.as_py(), sorted({entity(k, text[a:b]) for k, a, b in spans}), sorted(term_set(text, spans))))
                    size += len(text)
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], f.type) for c, f in enumerate(schema)], schema=schema)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], f.type) for c, f in enumerate(schema)], schema=schema)

    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return light.mapInArrow(released(run), "doc_id long, text_key string, entities array<string>, terms array<string>")


def beginnings(term: str) -> list[str]:
    """Names of the classes of a term."""
    return [f"{term[:k]}*" for k in BEGINNINGS if k < len(term)]


def beginnings_of(term: str | Column) -> Column:
    """The same as an array column."""
    return F.array_compact(F.array(*[F.when(F.length(term) > k, F.concat(F.substring(term, 1, k), F.lit("*"))) for k in BEGINNINGS]))


def document_counts(docs: DataFrame, names: DataFrame, broadcast_terms: int) -> DataFrame:
    """name, documents: in how many documents each of the named terms, or a term of each of the named classes, occurs outside of base spans."""
    n = names.count()
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in names.collect())) if n <= broadcast_terms else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        only = wanted.value if wanted else None
        known: dict[str, tuple[str, ...]] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["name", "documents"])
            held.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                found: set[str] = set()
                for x in term_set(text, base_spans(text)):
                    if (of := known.get(x)) is None:
                        of = known[x] = tuple(y for y in (x, *beginnings(x)) if only is None or y in only)
                    found.update(of)
                held.update(found)
                if len(held) > HELD:
                    yield out()
                if len(known) > KNOWN:
                    known.clear()
        yield out()

    # A task hands on a row for each name that it met: few and long tasks hand on less than many short ones.
    most = TASKS_A_CORE * docs.sparkSession.sparkContext.defaultParallelism
    counted = docs.select("text").coalesce(most).mapInArrow(released(run), "name string, documents long").groupBy("name").agg(F.sum("documents").alias("documents"))
    return counted if wanted else counted.join(names, "name", "left_semi")


def told_share(total: int) -> Column:
    """How much of an entity's information content a term tells. Columns: holders, documents, both."""
    content = F.log2(F.lit(total) / F.col("holders"))
    told = F.log2(F.col("both") * F.lit(total) / (F.col("holders") * F.col("documents")))
    return F.when(content > 0, told / content).otherwise(F.lit(0.0))


def classes_of(telling: DataFrame, term_sets: DataFrame, profiles: DataFrame, counts: DataFrame, total: int, generalise: float) -> DataFrame:
    """profile, term, class: the longest beginning of each generalised term whose class tells less than the threshold."""
    tried = stored(telling.where("not removed").select("profile", "term", F.explode(beginnings_of("term")).alias("name")), "pii-tried")
    held = term_sets.select("text_key", F.explode(F.array_distinct(F.flatten(F.transform("terms", beginnings_of)))).alias("name"))
    both = held.join(profiles, "text_key").join(tried.select("profile", "name").distinct(), ["profile", "name"], "left_semi")
    both = both.groupBy("profile", "name", "holders").agg(F.sum("n").alias("both")).join(counts, "name")
    safe = both.where(told_share(total) < generalise).select("profile", "name")
    return tried.join(safe, ["profile", "name"]).groupBy("profile", "term").agg(F.max(F.rtrim("name", F.lit("*"))).alias("class"))


def disclosed(docs: DataFrame, generalise: float, remove: float, broadcast_terms: int) -> DataFrame | None:
    """text_key, terms (TERMS): the disclosing terms of a text; None if there is none."""
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return _disclosed(docs, generalise, remove, broadcast_terms, keep)


def _disclosed(docs: DataFrame, generalise: float, remove: float, broadcast_terms: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame | None:
    rows = stored(found(docs), "pii-found")
    held = rows.select("doc_id", "text_key", F.explode("entities").alias("entity")).groupBy("entity", "text_key", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    held = stored(held.groupBy("entity", "text_key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("evidence")), "pii-held")
    sums = [F.sum(F.xxhash64("text_key", F.lit(i)).cast("decimal(38,0)")).cast("string") for i in range(2)]
    known = held.groupBy("entity").agg(F.sum("n").alias("holders"), F.sum("evidence").alias("e"), F.md5(F.concat_ws(":", F.count(F.lit(1)), *sums)).alias("profile"))
    profiles = held.join(known.where("e > 1").drop("e"), "entity").groupBy("text_key", "profile", "holders").agg(F.first("n").alias("n"), F.first("evidence").alias("evidence"))
    profiles = stored(profiles, "pii-profiles")
    if not profiles.limit(1).count():
        return None
    total = docs.count()
    # Documents of a term among those that hold any entity: no more than all its documents, so what can't tell enough by this number can't by the whole one. Nor can a term of one such document.
    low = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("low")).where("low > 1")
    most = profiles.groupBy("text_key").agg(F.max("holders").alias("most"))
    whole = stored(rows.select("text_key", "terms").dropDuplicates(["text_key"]).join(most, "text_key"), "pii-term-sets")
    texts = whole.select("text_key", "most", F.explode("terms").alias("term"))
    least_told = generalise - 1e-9
    can_tell = F.when(F.col("most") < total, F.log2(F.lit(total) / F.col("low")) >= least_told * F.log2(F.lit(total) / F.col("most"))).otherwise(False)
    texts = stored(texts.join(low, "term").where(can_tell).select("text_key", "term", "low"), "pii-texts")
    pairs = texts.join(profiles, "text_key")
    both = pairs.groupBy("profile", "term", "holders").agg(F.sum("n").alias("both"), F.sum("evidence").alias("e"), F.max("low").alias("documents")).where("e > 1")
    both = stored(both.where(told_share(total) >= least_told).drop("e", "documents"), "pii-both")
    names = both.select(F.explode(F.concat(F.array("term"), beginnings_of("term"))).alias("name")).distinct()
    counts = stored(document_counts(docs, stored(names, "pii-names"), broadcast_terms), "pii-counts")
    telling = both.join(counts.withColumnRenamed("name", "term"), "term").withColumn("share", told_share(total)).where(F.col("share") >= generalise)
    telling = stored(telling.select("profile", "term", (F.col("share") >= remove).alias("removed")), "pii-telling")
    classes = classes_of(telling, whole, profiles, counts, total, generalise)
    named = telling.join(classes, ["profile", "term"], "left").withColumn("class", F.coalesce("class", F.lit("")))
    # A term that tells of several entities is in the widest of its classes: the shortest beginning, which is the first.
    terms = pairs.join(named, ["profile", "term"]).groupBy("text_key", "term").agg(F.max("removed").alias("removed"), F.min("class").alias("class"))
    lists = keep(terms.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("term", "removed", "class"))).alias("terms")), "pii-lists")
    return lists if lists.limit(1).count() else None


def term_spans(text: str, spans: list[tuple[str, int, int]], terms: list[dict] | None) -> list[tuple[int, int, dict]]:
    """(start, end, term) of each occurrence of the terms, in order."""
    if not terms:
        return []
    known = {t["term"]: t for t in terms}
    return [(m.start(), m.end(), known[x]) for m in places(text, spans) if (x := m[0].lower()) in known]


def with_terms(docs: DataFrame, lists: DataFrame | None, key: str, held: str, broadcast_terms: int) -> DataFrame:
    """docs with the disclosing terms of each text as column ``held``."""
    none = F.lit(None).cast(TERMS)
    if lists is None:
        return docs.withColumn(held, none)
    docs, lists = docs.withColumn(key, text_key()), lists.withColumnsRenamed({"text_key": key, "terms": held})
    if lists.count() > broadcast_terms:
        return docs.join(lists, key, "left").drop(key)
    keys = F.broadcast(lists.select(key))
    some = docs.join(keys, key, "left_semi").join(lists, key)
    return some.unionByName(docs.join(keys, key, "left_anti").withColumn(held, none)).drop(key)


def rewrite(text: str | None, terms: list[dict] | None) -> str | None:
    """The text with base spans named by kind, and disclosing terms generalised or removed. Spans that overlap are one."""
    if text is None:
        return None
    base = base_spans(text)
    spans = [(a, b, f"[{k.upper()}]") for k, a, b in base]
    spans += [(a, b, "" if t["removed"] else f"[{t['class']}*]") for a, b, t in term_spans(text, base, terms)]
    if not spans:
        return text
    out, last = [], 0
    for a, b, name in sorted(spans, key=lambda x: (x[0], -x[1])):
        if a >= last:
            out += [text[last:a], name]
        last = max(last, b)
    return "".join([*out, text[last:]])


def sanitise(docs: DataFrame, generalise: float = 0.8, remove: float = 0.95, broadcast_terms: int = 200_000) -> DataFrame:
    """docs with rewritten texts; other columns as they are."""

    @F.arrow_udf("string")
    def both(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            yield pa.array([rewrite(x.as_py(), t.as_py()) for x, t in zip(texts, lists, strict=True)], pa.string())

    key, held = free_name(docs.columns, "_text_key"), free_name(docs.columns, "_terms")
    joined = with_terms(docs, disclosed(docs, generalise, remove, broadcast_terms), key, held, broadcast_terms)
    return joined.withColumn("text", both(F.col("text"), F.col(held))).select(*docs.columns)


def op4_pii(docs: DataFrame, generalise: float = 0.8, remove: float = 0.95, broadcast_terms: int = 200_000) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bases, all_spans = [], [], []
            for text, terms in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                spans = base_spans(text)
                n = Counter(k for k, _, _ in spans)
                counts.append([n[k] for k in KINDS])
                bases.append(joined(spans))
                all_spans.append(joined(spans + [("removed" if t["removed"] else "generalised", a, b) for a, b, t in term_spans(text or "", spans, terms.as_py())]))
            numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(bases, pa.string()), pa.array(all_spans, pa.string())], schema=schema)

    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = with_terms(light, disclosed(light, generalise, remove, broadcast_terms), "_k", "_terms", broadcast_terms).select("doc_id", "text", "_terms")
    rows = rows.mapInArrow(released(run), f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string")
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")

"""Secret scans with DataFrame functions only.

Fixed patterns give the base spans. Character Markov models add more: one bigram model of random
strings, one of ordinary identifiers, both counted in Spark from labelled samples; a part of a run of
token characters whose log-likelihood ratio favours the random model is a secret too. The ratio table
has one entry per pair of alphabet characters, so it is a small literal array. A text without
any match costs one regular-expression scan per kind and nothing else.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .bpe import let

#: Kinds in listed order with pattern and the least length of (group, length).
BASE_KINDS = {
    "assign": ("(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    # A maximal run shorter than 16 is dropped either way, so the bound may stand in the pattern.
    "hex": ("[0-9a-f]{16,}", 0, 16),
}
RANDOM_KIND = "random"

#: Characters of tokens and identifiers; anything else ends a run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]"
MIN_RUN = 12
SPAN = "array<struct<start:int,rank:int,stop:int,kind:string>>"
SPAN_TEXT = SPAN.replace("kind:string", "kind:string,text:string")


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` folded over what stands before each element of an int array, 0 before the first.

    An array grows by copying, so the fold goes over parts of about the root of the length, first over
    the parts' results and then within each part; a text with a hundred thousand matches stays cheap.
    """

    def fold(array: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(array, start, step, lambda acc: acc["out"])

    def by_parts(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1), lambda i: F.slice(v, i * width + 1, width))
        whole = lambda p: F.transform(p, lambda part: F.aggregate(part, F.lit(0), op))
        return let(parts, lambda p: let(fold(whole(p), F.lit(0)), lambda begins: F.flatten(F.transform(p, lambda part, k: fold(part, F.get(begins, k))))))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(values, by_parts))


def running_sums(values: Column) -> Column:
    return running(values, lambda acc, x: acc + x)


#: Code points of a block of :func:`blocks_of`.
BLOCK = 1_024


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK code points, in which a place is found without a walk from the text's start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(blocks: Column, start: Column, stop: Column) -> Column:
    """Code points ``start`` to ``stop`` (exclusive) of a text in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    few = F.array_join(F.slice(blocks, first + 1, F.floor((stop - 1) / BLOCK).cast("int") - first + 1), "")
    return F.when(stop > start, F.substring(few, start - first * BLOCK + 1, stop - start)).otherwise("")


def matches(text: Column, pattern: str, group: int, least: int, kind: str, rank: int, with_text: bool = False) -> Column:
    """Leftmost non-overlapping matches as spans in code points, ``with_text`` their texts too; those with a short group are dropped.

    The text between matches (split) and the matches themselves (regexp_extract_all) alternate, so
    running sums of their lengths give the positions.
    """

    def scan(found: Column) -> Column:
        length = F.transform(found["all"], lambda m: F.length(m))
        steps = F.transform(found["all"], lambda m, i: F.length(F.get(found["gaps"], i)) + F.length(m))

        def spans(sizes: Column) -> Column:
            def one(before: Column, i: Column) -> Column:
                begin = before + F.length(F.get(found["gaps"], i))
                own = [F.get(found["all"], i).alias("text")] if with_text else []
                return F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + F.get(sizes, i)).alias("stop"), F.lit(kind).alias("kind"), *own)

            every = F.transform(running_sums(steps), one)
            return F.filter(every, lambda _, i: F.length(F.get(found["groups"], i)) >= least) if group else F.filter(every, lambda s: s["stop"] - s["start"] >= least)

        return let(length, spans)

    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.struct(whole.alias("all"), (part if group else whole).alias("groups"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), let(found, scan)).otherwise(F.array().cast(SPAN_TEXT if with_text else SPAN))


def base_spans(text: Column) -> list[Column]:
    return [matches(text, pattern, group, least, kind, rank).alias(kind) for rank, (kind, (pattern, group, least)) in enumerate(BASE_KINDS.items())]


def train(samples: DataFrame, prior: float = 16.0) -> list[float]:
    """Log-likelihood ratios (random against ordinary) for each pair of characters, row by row.

    ``samples`` has token and label (1 random, 0 ordinary). Counts are summed in Spark; what reaches the
    driver is at most two counts per pair of alphabet characters. A context backs off to its label's
    single characters with the weight of ``prior`` pairs; an empty sample gives a ratio of 0 everywhere. Null tokens count as empty.
    """
    token = F.coalesce("token", F.lit(""))
    pairs = F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, F.lit(2)))
    counts = (
        samples.filter(F.length(token) > 1).select("label", F.explode(pairs).alias("pair"))
        .filter(F.col("pair").rlike(f"^{RUN}{RUN}$")).groupBy("label", "pair").count().collect()
    )
    n = len(ALPHABET)
    tables = [[[0.0] * n for _ in ALPHABET] for _ in range(2)]
    for row in counts:
        if row.label in (0, 1):
            tables[row.label][ALPHABET.index(row.pair[0])][ALPHABET.index(row.pair[1])] += row["count"]
    logs = []
    for table in tables:
        singles = [1 + sum(line[b] for line in table) for b in range(n)]
        share = [x / sum(singles) for x in singles]
        logs.append([math.log((line[b] + prior * share[b]) / (sum(line) + prior)) for line in table for b in range(n)])
    return [random - ordinary for ordinary, random in zip(*logs, strict=True)]


def threshold_of(model: list[float]) -> float:
    """Half of what MIN_RUN evenly drawn characters score on average; by the likelihood ratio a part of ordinary text reaches T with odds of at most exp(-T), so 10 at least."""
    return max(10.0, (MIN_RUN - 1) * sum(model) / len(model) / 2)


def random_parts(token: Column, begin: Column, model: list[float], threshold: float) -> Column:
    """Spans of the token's parts whose summed pair ratios reach ``threshold``, from MIN_RUN characters on.

    A running sum starts anew where it falls to 0 or by ``threshold`` below its maximum, so ordinary text
    beside or between random parts does not outweigh them. A part ends with whole pieces between signs: one
    at its edge is taken in, or left out where the lesser half is inside. Parts that overlap become one. ``begin`` is the token's place in the text.
    """
    n = len(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    part = "array<struct<first:int,last:int>>"

    def closed(acc: Column) -> Column:
        one = F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"))).cast(part)
        return F.when(acc["best"] >= threshold, F.concat(acc["out"], one)).otherwise(acc["out"])

    def step(acc: Column, i: Column, ratio: Column) -> Column:
        total = acc["sum"] + ratio
        ends = (total <= 0) | (total < acc["best"] - threshold)
        higher = total > acc["best"]
        return F.struct(
            F.when(ends, 0.0).otherwise(total).alias("sum"), F.when(ends, i).otherwise(acc["from"]).alias("from"),
            F.when(ends, 0.0).when(higher, total).otherwise(acc["best"]).alias("best"),
            F.when(ends, i).when(higher, acc["from"]).otherwise(acc["first"]).alias("first"), F.when(ends, i).when(higher, i).otherwise(acc["last"]).alias("last"),
            F.when(ends, closed(acc)).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(
        F.lit(0.0).alias("sum"), F.lit(0).alias("from"), F.lit(0.0).alias("best"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.array().cast(part).alias("out")
    )
    parts = let(F.struct(table.alias("ratios"), codes.alias("at")), lambda t: F.aggregate(
        F.sequence(F.lit(1), F.size(t["at"]) - 1), zero,
        lambda acc, i: step(acc, i, F.coalesce(F.get(t["ratios"], F.get(t["at"], i - 1) * n + F.get(t["at"], i)), F.lit(0.0))), closed,
    ))

    def whole_pieces(p: Column) -> Column:
        inside = F.substring(token, p["first"] + 1, p["last"] - p["first"] + 1)
        before = F.length(F.regexp_extract(F.reverse(F.substring(token, F.lit(1), p["first"])), "^[A-Za-z0-9]*", 0))
        after = F.length(F.regexp_extract(F.substring(token, p["last"] + 2, F.length(token)), "^[A-Za-z0-9]*", 0))
        head, tail = F.regexp_extract(inside, "^[A-Za-z0-9]*[+/_=-]+", 0), F.regexp_extract(inside, "[+/_=-]+[A-Za-z0-9]*$", 0)
        of = lambda edge: F.length(F.regexp_replace(edge, "[+/_=-]", ""))
        return F.struct(
            (p["first"] + F.when((head != "") & (before > of(head)), F.length(head)).otherwise(-before)).alias("first"),
            (p["last"] - F.when((tail != "") & (after > of(tail)), F.length(tail)).otherwise(-after)).alias("last"),
        )

    def merge(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        both = F.array(F.struct(F.least(last["first"], p["first"]).alias("first"), F.greatest(last["last"], p["last"]).alias("last")))
        overlap = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["last"] >= p["first"])
        return F.when(overlap, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), both)).otherwise(F.concat(acc, F.array(p)))

    whole = F.aggregate(F.transform(parts, whole_pieces), F.array().cast(part), merge)
    long = F.filter(whole, lambda p: p["last"] - p["first"] + 1 >= MIN_RUN)
    return F.transform(long, lambda p: span_of(begin + p["first"], begin + p["last"] + 1))


def span_of(start: Column, stop: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(len(BASE_KINDS)).alias("rank"), stop.alias("stop"), F.lit(RANDOM_KIND).alias("kind"))


def random_spans(text: Column, model: list[float], threshold: float) -> Column:
    """The random parts of all runs of at least MIN_RUN token characters."""
    runs = matches(text, f"{RUN}{{{MIN_RUN},}}", 0, MIN_RUN, RANDOM_KIND, len(BASE_KINDS), with_text=True)
    return F.flatten(F.transform(runs, lambda r: random_parts(r["text"], r["start"], model, threshold)))


def outside(spans: Column, base: Column) -> Column:
    """What the sorted spans of ``base`` leave of each of ``spans``, as spans.

    ``base`` is looked through in parts of about the root of its length, so many spans among many stay cheap.
    """

    def left_of(span: Column, parts: Column) -> Column:
        near = F.filter(parts, lambda p: (p["low"] < span["stop"]) & (span["start"] < p["high"]))
        touching = F.filter(F.flatten(F.transform(near, lambda p: p["of"])), lambda b: (b["start"] < span["stop"]) & (span["start"] < b["stop"]))

        def cut(acc: Column, b: Column) -> Column:
            left = F.when(b["start"] > acc["at"], F.concat(acc["out"], F.array(span_of(acc["at"], b["start"])).cast(SPAN))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], b["stop"]).alias("at"), left.alias("out"))

        rest = lambda acc: F.when(acc["at"] < span["stop"], F.concat(acc["out"], F.array(span_of(acc["at"], span["stop"])).cast(SPAN))).otherwise(acc["out"])
        return F.aggregate(touching, F.struct(span["start"].alias("at"), F.array().cast(SPAN).alias("out")), cut, rest)

    def in_parts(b: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(b))).cast("int")
        part = lambda of: F.struct(of.alias("of"), F.get(of, F.lit(0))["start"].alias("low"), F.array_max(F.transform(of, lambda s: s["stop"])).alias("high"))
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(b) / width).cast("int") - 1), lambda k: let(F.slice(b, k * width + 1, width), part))
        return let(parts, lambda p: F.flatten(F.transform(spans, lambda s: left_of(s, p))))

    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(let(base, in_parts))


def find_secrets(docs: DataFrame, model: list[float], threshold: float | None = None, text_column: str = "text") -> DataFrame:
    """Adds ``assign``, ``access``, ``hex`` and ``random``: arrays of spans (start, rank, stop, kind).

    A document column of one of these names is replaced. Null and empty texts have none. Positions are code points, the end exclusive. A random span is
    trimmed around base spans, which stay; its rest may be short. Without a ``threshold`` the model sets it. Every other column is kept; repeated rows are
    treated alike; an empty table stays empty.
    """
    text = F.coalesce(text_column, F.lit(""))
    docs = docs.drop(*BASE_KINDS, RANDOM_KIND)
    with_base = docs.select("*", *base_spans(text))
    found = random_spans(text, model, threshold_of(model) if threshold is None else threshold)
    base = F.array_sort(F.concat(*BASE_KINDS))
    return with_base.withColumn(RANDOM_KIND, let(found, lambda spans: outside(spans, base)))


def corpus_samples(docs: DataFrame, ordinary_documents: int = 2_000) -> DataFrame:
    """Labelled samples: every base span's text of all documents against words of a bounded sample.

    The ordinary identifiers come from about ``ordinary_documents`` documents, those with the smallest hashes;
    they stay where they are, and only counts of pairs leave a task. A base span among them is no
    ordinary word.
    """
    text = F.coalesce("text", F.lit(""))
    any_base = "|".join(pattern for pattern, _, _ in BASE_KINDS.values())
    found = [matches(F.col("text"), pattern, group, least, kind, rank, with_text=True) for rank, (kind, (pattern, group, least)) in enumerate(BASE_KINDS.items())]
    spans = docs.select(text.alias("text")).filter(F.col("text").rlike(any_base)).select(F.explode(F.concat(*found)).alias("s"))  # the matches' texts alone are copied
    random = spans.select(F.explode(F.regexp_extract_all("s.text", F.lit(f"{RUN}{{12,}}"), F.lit(0))).alias("token"), F.lit(1).alias("label"))
    few = docs.filter(shared.smallest_hashes(["doc_id", "text"], ordinary_documents, docs.count())).select(text.alias("text"))
    plain = F.regexp_replace("text", any_base, " ")
    ordinary = few.select(F.explode(F.regexp_extract_all(plain, F.lit(f"{RUN}{{4,}}"), F.lit(0))).alias("token"), F.lit(0).alias("label"))
    return random.unionByName(ordinary)


def redact(docs: DataFrame, model: list[float], mask: str = "[SECRET]") -> DataFrame:
    """The documents with each secret span replaced by ``mask`` (n_chars follows); all rows stay.

    Spans that overlap or touch become one mask. Null and empty texts stay as they are; repeated rows are
    treated alike; an empty table stays empty; other columns, whatever their names, are kept.
    """
    whole = shared.row_and_columns(docs, F.coalesce("text", F.lit("")).alias("text"))
    found = find_secrets(whole, model).withColumn("spans", F.array_sort(F.concat(*BASE_KINDS, RANDOM_KIND)))

    def joined(at: Column) -> Column:
        """What stands between masks: from the end of all spans before one (``ends``) to its start, if that is no earlier."""
        spans, ends, blocks = at["spans"], at["ends"], at["blocks"]
        first = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda k: (k == 0) | (F.get(spans, k)["start"] > F.get(ends, k)))
        between = F.transform(first, lambda k: piece(blocks, F.get(ends, k), F.get(spans, k)["start"]))
        last = piece(blocks, F.array_max(F.transform(spans, lambda s: s["stop"])), at["n"])
        return F.array_join(F.concat(between, F.array(last)), mask)

    ends = running(F.transform("spans", lambda s: s["stop"]), lambda acc, x: F.greatest(acc, x))
    masked = let(F.struct(F.col("spans").alias("spans"), ends.alias("ends"), blocks_of(F.col("text")).alias("blocks"), F.length("text").alias("n")), joined)
    changed = F.size("spans") > 0
    out = found.withColumn("masked", F.when(changed, masked).otherwise(F.col("row.text")))
    replaced = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.when(changed, F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*shared.row_fields(docs, **replaced))


def written_spans(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", "text")
    found = find_secrets(docs, train(corpus_samples(docs)))
    return found.select(
        "doc_id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(written_spans(F.concat(*BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        written_spans(F.concat(*BASE_KINDS, RANDOM_KIND)).alias("spans"),
    )


QUERIES = {"op5_secrets": op5_secrets}
ORACLE_SQL: dict[str, str] = {}

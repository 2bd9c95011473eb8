"""Secret scan with DataFrame functions only: rule matches, and spans that two character Markov models tell apart.

Rules: assignments, access keys and hexadecimal runs. Beside them, long runs of key characters are scored by the
log-likelihood ratio of first-order Markov models of random strings and of ordinary identifiers. Both are counted
from labelled samples: random strings are those that the rules find and digests in several alphabets; ordinary
ones are words of the texts and identifiers joined from them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

# fixed values
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

#: At most about so many documents give ordinary words to the model; so many digests give random strings. One in
#: HELD_BACK strings of either class isn't counted: those set the threshold.
SAMPLE_DOCUMENTS = 2000
SAMPLE_DIGESTS = 4000
HELD_BACK = 5
#: Where held back strings don't tell the classes apart, or are none: the mean ratio, in bits a character pair, from
#: which a run is random.
THRESHOLD = 1.2
#: Hits whose places are summed up at once.
CHUNK = 64

SPAN = "struct<start:int,kind:int,end:int>"


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _located(text: Column, pattern: str, hits: Column, kind: int) -> Column:
    """Spans of the hits of a pattern: the pieces between them give the places, in code points.

    Places are sums of what comes before, first over chunks of hits and then inside each: appending to one array
    for all hits would copy it for every hit.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), F.transform(hits, F.length), lambda g, n: F.struct(g.alias("gap"), n.alias("size")))
    chunk = lambda c: F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK))
    numbers = F.sequence(F.lit(0), F.ceil(F.size(hits) / CHUNK).cast("int") - 1)
    totals = F.transform(numbers, lambda c: F.aggregate(chunk(c), F.lit(0), lambda acc, x: acc + x["gap"] + x["size"]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    begins = F.aggregate(totals, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + x["size"]
        item = F.struct(s.alias("start"), F.lit(kind).alias("kind"), e.alias("end"))
        return F.struct(e.alias("at"), F.array_append(acc["out"], item).alias("out"))

    inside = lambda c, at: F.aggregate(chunk(c), F.struct(at.alias("at"), _none().alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(hits) == 0, _none()).otherwise(F.flatten(F.zip_with(numbers, begins, inside)))


def _kept(spans: Column, flags: Column) -> Column:
    both = F.zip_with(spans, flags, lambda s, ok: F.struct(s.alias("s"), ok.alias("ok")))
    return F.transform(F.filter(both, lambda x: x["ok"]), lambda x: x["s"])


def with_base(docs: DataFrame, text: str = "_t") -> DataFrame:
    """Adds _base: the rules' spans by start, then kind. Leftmost, non-overlapping within a kind."""
    t = F.col(text)
    step = docs.withColumns({f"_h{k}": F.regexp_extract_all(t, F.lit(p), F.lit(0)) for k, p in enumerate((ASSIGN, ACCESS, HEX))})
    found = [_located(t, p, F.col(f"_h{k}"), k) for k, p in enumerate((ASSIGN, ACCESS, HEX))]
    # an assignment counts from 12 characters of value on; one that fails still takes up its place
    long_enough = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 12)
    kept = F.when(F.size("_h0") == 0, found[0]).otherwise(_kept(found[0], long_enough))
    step = step.withColumn("_base", F.array_sort(F.concat(kept, found[1], found[2])))
    return step.drop("_h0", "_h1", "_h2")


def _codes(s: Column) -> Column:
    return F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def _pair_codes(s: Column) -> Column:
    """Codes of neighbouring characters; the alphabet's size is the stride."""
    codes = _codes(F.regexp_replace(s, r"[^A-Za-z0-9+/_=-]", ""))
    n = len(ALPHABET)
    pairs = F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: a * n + b)
    return F.when(F.size(codes) < 2, F.array().cast("array<int>")).otherwise(pairs)


def fit(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, id_col: str = "doc_id") -> dict:
    """The model: ratios in bits of each character pair, random against ordinary, with add-one smoothing, and the
    mean ratio from which a run counts as random, with the shares of held back strings that it finds and flags.

    The sample is drawn by a hash of the id and staged once; a table with no words gives a model of the digests alone.
    """
    spark = docs.sparkSession
    n = max(docs.count(), 1)
    share = min(1.0, sample_documents / n)
    picked = docs.where(F.pmod(F.xxhash64(F.lit(29), F.col(id_col)), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = stage(picked.select(F.coalesce("text", F.lit("")).alias("_t")), "secret-sample")
    base = with_base(texts).select(F.explode("_base").alias("s"), "_t").select(F.expr("substring(_t, s.start + 1, s.end - s.start)").alias("w"))
    base = base.select(F.regexp_replace("w", r"""^(?i:password|passwd|secret|token|api_?key|akia)["']?\x20*[:=]?\x20*["']?""", "").alias("w"))
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    raw = F.unhex(digest)
    digests = spark.range(SAMPLE_DIGESTS).select(F.explode(F.array(F.substring(digest, 1, 40), F.base64(raw), F.translate(F.base64(raw), "+/=", "-_"), F.upper(F.regexp_replace(F.base64(raw), "[a-z+/=]", "")))).alias("w"))
    plain = F.regexp_extract_all("_t", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,}(?![A-Za-z0-9+/_=-])"), F.lit(0))
    # equal words are counted before they are joined to identifiers, each with the next one in hash order
    single = texts.select(F.explode(plain).alias("w")).groupBy("w").agg(F.count("*").alias("count"))
    single = stage(single, "secret-words")
    after = F.lead("w").over(Window.partitionBy(F.pmod(F.xxhash64("w"), F.lit(64))).orderBy(F.xxhash64(F.lit(7), "w"), "w"))
    a, b = F.lower("w"), F.lower("after")
    joined = single.withColumn("after", after).where("after IS NOT NULL").select(F.explode(F.array(F.concat_ws("_", a, b), F.concat(a, F.initcap(b)), F.concat_ws("-", a, b), F.concat_ws("/", a, b))).alias("w"), F.lit(1).alias("count"))
    upper = single.select(F.upper("w").alias("w"), "count")
    plain_words = single.unionByName(joined).unionByName(upper).withColumn("c", F.lit(0))
    both = base.unionByName(digests).withColumns({"c": F.lit(1), "count": F.lit(1)}).unionByName(plain_words)
    both = both.groupBy("c", "w").agg(F.sum("count").alias("count"))
    both = stage(both.withColumn("held", F.pmod(F.xxhash64(F.lit(31), "w"), F.lit(HELD_BACK)) == 0), "secret-strings")
    size = len(ALPHABET)
    # at most two rows for each pair of characters of the fixed alphabet
    pairs = both.where("NOT held").select("c", "count", F.explode(_pair_codes(F.col("w"))).alias("p"))
    counts = pairs.groupBy("c", "p").agg(F.sum("count").alias("n")).collect()
    table = [[1.0] * (size * size), [1.0] * (size * size)]
    for r in counts:
        if 0 <= r["p"] < size * size:
            table[r["c"]][r["p"]] += r["n"]
    ratios = []
    for a in range(size):
        rows = [t[a * size : (a + 1) * size] for t in table]
        sums = [sum(x) for x in rows]
        ratios += [math.log2(y / sums[1]) - math.log2(x / sums[0]) for x, y in zip(*rows, strict=True)]
    scored = both.where("held").where(F.col("w").rlike(f"^{RUN}$")).select("c", _ratio(F.col("w"), _literal(ratios)).alias("x"))
    ordinary, random = F.col("c") == 0, F.col("c") == 1
    cut = scored.agg(F.percentile(F.when(ordinary, F.col("x")), 0.999).alias("low"), F.percentile(F.when(random, F.col("x")), 0.02).alias("high")).first()
    apart = cut["low"] is not None and cut["high"] is not None and cut["low"] < cut["high"]
    threshold = (cut["low"] + cut["high"]) / 2 if apart else THRESHOLD
    hit = (F.col("x") >= threshold).cast("double")
    rates = scored.agg(F.avg(F.when(random, hit)).alias("found"), F.avg(F.when(ordinary, hit)).alias("flagged")).first()
    return {"ratios": ratios, "threshold": threshold, "found": rates["found"], "flagged": rates["flagged"]}


def _literal(ratios: list[float]) -> Column:
    """One literal, folded once: thousands of column objects would take the driver seconds."""
    return F.split(F.lit(",".join(repr(round(x, 6)) for x in ratios)), ",").cast("array<double>")


def _ratio(s: Column, table: Column) -> Column:
    pairs = _pair_codes(s)
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.element_at(table, p + 1))
    return F.try_divide(total, F.length(s) - 1)


def scan(docs: DataFrame, model: dict, base_col: str = "base_spans", spans_col: str = "spans") -> DataFrame:
    """``docs`` with two columns more: base_spans and spans, arrays of (start, kind, end) by start, then kind.

    Spans are in code points, ends exclusive. A null text is scanned as an empty one, a long one whole; repeated rows
    give the same spans each time; an empty table gives no rows. Columns of ``docs`` that have the names of the two
    give way to them, all others stay as they are. A run that touches a rule's span adds nothing.
    """
    table = _literal(model["ratios"])
    own = [c for c in docs.columns if c.lower() not in (base_col.lower(), spans_col.lower())]
    # the row's own columns travel in a struct, where no name of a step can meet them
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.coalesce("text", F.lit("")).alias("_t"))
    based = with_base(packed).withColumn("_runs", F.regexp_extract_all("_t", F.lit(RUN), F.lit(0)))
    # characters of keys and digests are those of a run, so such a match lies inside one; assignments reach over it
    own_rule = lambda r: r.rlike(ACCESS) | r.rlike(HEX)
    based = based.withColumn("_random", F.transform("_runs", lambda r: ~own_rule(r) & (_ratio(r, table) >= model["threshold"])))
    found = _kept(_located(F.col("_t"), RUN, F.col("_runs"), 3), F.col("_random"))
    based = based.withColumn("_more", F.when(F.exists("_random", lambda x: x), found).otherwise(_none()))
    based = based.withColumn("_assigned", F.filter("_base", lambda b: b["kind"] == 0))
    apart = F.filter("_more", lambda m: ~F.exists("_assigned", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    based = based.withColumn("_more", F.when((F.size("_more") == 0) | (F.size("_assigned") == 0), F.col("_more")).otherwise(apart))
    spans = F.array_sort(F.concat("_base", "_more"))
    return based.select(*[F.col("_row").getField(c).alias(c) for c in own], F.col("_base").alias(base_col), spans.alias(spans_col))


def as_text(spans: str | Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each span, or union of overlapping spans, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)

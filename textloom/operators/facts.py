"""Triplets, facts, lengths and records (families G, H, L)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def bundle_texts(sources: DataFrame, piece: int = 3000, total: int = 8000, least: int = 100) -> DataFrame:
    """``(topic_id, bundle)``: the beginnings of a topic's sources, in order, while their size is under ``total``.

    Each piece is longer than ``least``, so the rank limit loses nothing; it lets every partition
    drop the rest of a topic before the shuffle.
    """
    order = Window.partitionBy("topic_id").orderBy("src_idx", "doc_id")
    rows = sources.filter(F.length("content") > least).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= total // least + 1)
    rows = rows.withColumn("piece", F.substring("content", 1, piece))
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).filter(F.col("before") < total)
    found = rows.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "piece"))).alias("p"))
    found = found.select("topic_id", F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("bundle"))
    return found.filter(F.length("bundle") >= 200)


def normalise_causal(df: DataFrame, kinds: tuple = ("causes", "prevents", "requires", "enables", "leads_to")) -> DataFrame:
    """Trimmed, clipped cause and effect, a known relation and a confidence of 0.3 to 0.95."""
    rows = df.withColumns({"cause": F.substring(F.trim("cause"), 1, 80), "effect": F.substring(F.trim("effect"), 1, 80)})
    rows = rows.filter((F.length("cause") >= 3) & (F.length("effect") >= 3))
    kind = F.when(F.col("relation").isin(*kinds), F.col("relation")).otherwise("causes")
    return rows.withColumns({"relation": kind, "confidence": F.greatest(F.lit(0.3), F.least(F.lit(0.95), "confidence"))})


def different_links(df: DataFrame) -> DataFrame:
    """The different rows of ``df``, from one shuffle for all that read them.

    The filter asks each reader for the count of a link; of a plain ``distinct`` the optimizer makes each reader's columns from the texts anew.
    """
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 0").drop("__n")


def mark_chains(df: DataFrame, limit: int = 15) -> DataFrame:
    """Add ``is_chain``: the cause begins as some effect of the topic does, or the effect as some cause."""
    def key(c: str) -> Column:
        return F.array_join(F.slice(F.split(F.lower(c), r"\s+"), 1, 3), " ")

    rows = df.withColumns({"__c": key("cause"), "__e": key("effect")})
    causes = rows.select(F.struct("topic_id", "__c").alias("__e"), F.lit(True).alias("__to")).distinct()
    effects = rows.select(F.struct("topic_id", "__e").alias("__c"), F.lit(True).alias("__from")).distinct()
    rows = rows.withColumns({c: F.struct("topic_id", c) for c in ("__c", "__e")}).join(causes, "__e", "left").join(effects, "__c", "left")  # a struct is not null, so all three read the same rows
    rows = rows.withColumn("is_chain", F.col("topic_id").isNotNull() & F.coalesce("__to", "__from", F.lit(False))).drop("__c", "__e", "__to", "__from")
    order = Window.partitionBy("topic_id").orderBy(F.desc("is_chain"), F.desc("confidence"), "cause", "effect", "relation")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def target_length(docs: DataFrame, topic: str = "lang", text: str = "text", default: int = 2000) -> DataFrame:
    """``(topic, target, intro, mean_words)``: floor median of lengths over 200 words.

    The exact percentile keeps a count per distinct length, not the lengths of all documents.
    """
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    rows = docs.select(topic, n.alias("n")).groupBy(topic)
    long = F.when(F.col("n") > 200, F.col("n"))
    rows = rows.agg(F.floor(F.coalesce(F.percentile(long, 0.5), F.lit(default))).alias("target"), F.round(F.coalesce(F.avg(long), F.lit(0.0)), 4).alias("mean_words"))
    return rows.withColumn("intro", F.least(F.lit(180), F.floor(F.col("target") / 9)).cast("long"))


def hard_facts(docs: DataFrame, patterns: dict[str, str], topic: str = "lang", text: str = "text", limit: int = 25, key: str = "doc_id", around: int = 60) -> DataFrame:
    """``(topic, kind, value, n, context, rank)``: facts by pattern, one row per value without its spaces, with what stands around it in its first document."""
    def found(kind: str, pattern: str) -> Column:
        values = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
        start = lambda v: F.greatest(F.instr(text, v) - around, F.lit(1))
        context = lambda v: F.col(text).substr(start(v), F.instr(text, v) + F.length(v) + around - start(v))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), F.regexp_replace(v, r"\s+", "").alias("value"), context(v).alias("context")))

    each = F.concat(*[found(k, p) for k, p in patterns.items()])
    rows = docs.select(topic, key, F.explode(each).alias("f")).filter(F.length("f.value") > 2)
    rows = rows.groupBy(topic, "f.kind", "f.value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(key, "f.context"))["context"].alias("context"))
    order = Window.partitionBy(topic).orderBy(F.desc("n"), "kind", "value")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def dedup_records(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` of the first record of each upper-cased, space-free signature; records without one all stay."""
    rows = df.withColumn("__s", F.upper(F.regexp_replace(text, r"\s+", "")))
    bare = rows.filter("__s IS NULL OR __s = ''").select(*keys)
    kept = rows.filter("__s <> ''").groupBy(F.md5("__s").alias("__d")).agg(F.min(F.struct(*keys)).alias("k")).select("k.*")
    return kept.unionByName(bare)


def parse_budgets(lines: DataFrame) -> DataFrame:
    """``(topic_id, phrase, low, high)`` from ``lines(topic_id, pos, line)``: a range, one number, or a bare phrase (1 to 99).

    The last line of a phrase wins.
    """
    ranged, single = r"^\s*(.+?)\s*:\s*(\d+)\s*[-–—]\s*(\d+)\s*[x×]?\s*$", r"^\s*(.+?)\s*:\s*(\d+)\s*[x×]?\s*$"
    line = F.col("line")

    def made(phrase: Column, low: Column, high: Column) -> Column:
        return F.struct(F.lower(F.trim(phrase)).alias("phrase"), low.cast("int").alias("low"), high.cast("int").alias("high"))

    got = F.when(line.rlike(ranged), made(F.regexp_extract(line, ranged, 1), F.regexp_extract(line, ranged, 2), F.regexp_extract(line, ranged, 3)))
    got = got.when(line.rlike(single), made(F.regexp_extract(line, single, 1), F.lit(1), F.regexp_extract(line, single, 2)))
    rows = lines.select("topic_id", "pos", got.otherwise(made(line, F.lit(1), F.lit(99))).alias("b")).filter("b.phrase <> ''")
    return rows.groupBy("topic_id", "b.phrase").agg(F.max_by("b", "pos").alias("b")).select("topic_id", "phrase", "b.low", "b.high")


def key_path(causal: DataFrame, plain: tuple[str, ...] = ("causes", "leads_to")) -> DataFrame:
    """``(topic_id, path)`` of ``mark_chains``: a topic's first link of a chain, else its first link, by confidence, with the relation unless it is a ``plain`` one."""
    first = causal.groupBy("topic_id").agg(F.min(F.struct((~F.col("is_chain")).alias("lone"), (-F.col("confidence")).alias("c"), "cause", "effect", "relation")).alias("b"))
    middle = F.when(~F.col("b.relation").isin(*plain) & (F.col("b.relation") != ""), F.col("b.relation"))
    return first.select("topic_id", F.concat_ws(" → ", "b.cause", middle, "b.effect").alias("path"))

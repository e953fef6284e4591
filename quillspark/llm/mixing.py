"""Mixing sources to target weights by hierarchical budgets. DataFrame operations only.

Weights go down a tree of domain, language and source. Each node's tokens times ``max_epochs`` are its capacity. A parent's
budget is shared among its children by weight; a child that cannot use its share keeps its capacity, and what it leaves
goes to its siblings by weight, again and again; only what all siblings together cannot use is left to the level above,
as a parent's capacity is that of its children. Shares are whole tokens and add up to the budget.

A leaf's stream is its documents in a seeded order, epoch after epoch, each in a new order; it takes the first tokens of
that stream up to its budget: some whole epochs and a prefix of one more, the last document cut.

Only the last epoch's cut needs an order. Documents fall into 4096 hash buckets a leaf; running sums over bucket totals
find the one where the budget ends, and only its documents are sorted. So a leaf with a third of all rows is no single
task's work.

Nulls: null languages and sources are "-", null texts have no tokens. Null doc_ids share one place in the order; repeated
rows, and rows of one doc_id, are taken each. Leaves without tokens get no budget. Empty tables give empty results. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, free_name, materialise, read_table

#: SQL for a source's domain, and weights by name; others count 1.
DOMAIN = "CASE WHEN source = 'src0' THEN 'crawl' WHEN length(source) = 4 THEN 'reference' WHEN source IS NULL THEN '-' ELSE 'community' END"
DOMAIN_WEIGHTS = {"crawl": 2, "reference": 3, "community": 4}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
SOURCE_WEIGHTS = {"src3": 3, "src12": 2}
#: The whole budget as a share of all tokens, in thousandths.
SHARE = 800
MAX_EPOCHS = 3
SEED = 17
#: Leaves that may be broadcast.
SMALL = 100_000


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _weight(name: str, weights: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(name)), F.lit(1)).cast("long")


def share_out(children: DataFrame, parent: list[str], name: str, budget: str) -> DataFrame:
    """``children`` (parent columns, name, capacity, weight, budget of the parent) with the column ``share``.

    In the order of capacity over weight, a child is filled to its capacity as long as that is within what the budget
    that is left gives it by weight; all after it share by weight. Remainders of the division go one token each.
    """
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("capacity").cast("double") / F.col("weight"), name)
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    big = "decimal(38,0)"
    df = children.withColumn("before", F.coalesce(F.sum("capacity").over(so_far), F.lit(0))).withColumn("onward", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.col("capacity").cast(big) * F.col("onward").cast("decimal(18,0)") <= F.col("weight").cast("decimal(18,0)") * (F.col(budget) - F.col("before")).cast(big)
    df = df.withColumn("full", fits).withColumn("rest", F.col(budget) - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0)))
    df = df.withColumn("rest_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(group))
    df = df.withColumn("part", F.when(~F.col("full"), F.expr("cast(rest as decimal(38,0)) * cast(weight as decimal(18,0)) div rest_weight")))
    spare = F.col("rest") - F.sum("part").over(group)
    place = F.row_number().over(group.orderBy("full", name))
    df = df.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(F.col("part") + F.when(place <= spare, 1).otherwise(0)).cast("long"))
    return df.drop("before", "onward", "full", "rest", "rest_weight", "part")


def budgets(leaves: DataFrame, share: int, max_epochs: int) -> DataFrame:
    """(domain, lang, source, n, budget) from (domain, lang, source, n: tokens)."""
    leaves = leaves.withColumn("capacity", F.col("n") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.sum("n").alias("n"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("n").alias("n"))
    total = domains.agg(F.sum("n").alias("all")).select((F.col("all") * share).alias("all")).selectExpr("all div 1000 as total")
    top = share_out(domains.drop("n").withColumn("weight", _weight("domain", DOMAIN_WEIGHTS)).crossJoin(F.broadcast(total)), [], "domain", "total")
    langs = langs.drop("n").withColumn("weight", _weight("lang", LANG_WEIGHTS)).join(top.select("domain", F.col("share").alias("total")), "domain")
    langs = share_out(langs, ["domain"], "lang", "total").select("domain", "lang", F.col("share").alias("total"))
    leaves = leaves.withColumn("weight", _weight("source", SOURCE_WEIGHTS)).join(langs, ["domain", "lang"])
    return share_out(leaves, ["domain", "lang"], "source", "total").select("domain", "lang", "source", "n", F.col("share").alias("budget"))


def plan(keys: DataFrame, share: int = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """keys: doc_id, domain, lang, source, n_tokens. Adds budget, epochs (whole ones) and taken (tokens of the next).

    Columns of ``carry`` go through; rows with one doc_id and as many tokens follow each other by these.
    """
    leaf = ["domain", "lang", "source"]
    found = materialise(budgets(keys.groupBy(*leaf).agg(F.sum("n_tokens").alias("n")).filter("n > 0"), share, max_epochs))
    if found.count() <= SMALL:
        found = F.broadcast(found)
    keys = keys.join(found.selectExpr(*leaf, "budget", "budget div n AS epochs", "budget % n AS left_over"), leaf, "left")
    keys = keys.withColumns({"budget": F.coalesce("budget", F.lit(0)), "epochs": F.coalesce("epochs", F.lit(0)), "left_over": F.coalesce("left_over", F.lit(0))})
    place = F.md5(F.concat_ws("|", F.lit(seed), F.col("epochs"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    keys = materialise(keys.withColumn("place", place).withColumn("bucket", F.substring("place", 1, 3)))
    upto = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = keys.groupBy(*leaf, "bucket", "left_over").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    cuts = materialise(buckets.filter("before < left_over and before + n >= left_over").select(*leaf, F.col("bucket").alias("cut"), "before"))
    if found.count() <= SMALL:
        cuts = F.broadcast(cuts)
    keys = keys.join(cuts, leaf, "left")
    inside = keys.filter("bucket = cut")
    within = Window.partitionBy(*leaf).orderBy("place", "n_tokens", *carry).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    inside = inside.withColumn("taken", F.greatest(F.lit(0), F.least("n_tokens", F.col("left_over") - ahead)))
    others = keys.filter("cut is null or bucket <> cut").withColumn("taken", F.when(F.col("bucket") < F.col("cut"), F.col("n_tokens")).otherwise(0))
    return others.unionByName(inside).select("doc_id", *leaf, "n_tokens", "budget", "epochs", F.col("taken").cast("long").alias("taken"), *carry)


def keys_of(docs: DataFrame, domain: str = DOMAIN, carry: tuple[str, ...] = ()) -> DataFrame:
    plain = docs.select("doc_id", "lang", "source", tokens(F.col("text")).alias("n_tokens"), *carry)
    return plain.select("doc_id", F.expr(domain).alias("domain"), F.coalesce("lang", F.lit("-")).alias("lang"), F.coalesce("source", F.lit("-")).alias("source"), "n_tokens", *carry)


def mix(docs: DataFrame, share: int = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Documents as often as they are taken: once a whole epoch, and once more if the last one's prefix reaches them.

    Documents stay whole: the one in which a leaf's prefix ends is taken to its end. A row is known by all its columns (but
    maps), so rows of one doc_id are taken each; rows that agree in all are taken as often as they are together.
    """
    times, row, id_, r1, r2 = (free_name(docs, x) for x in ("mix_times", "mix_row", "mix_id", "mix_hash_1", "mix_hash_2"))
    told = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind]
    rows = docs.withColumns({r1: F.xxhash64(*told), r2: F.xxhash64(F.lit(1), *told)})
    taken = plan(materialise(keys_of(rows, carry=(r1, r2))), share, max_epochs, seed, (r1, r2))
    each = taken.groupBy(F.col("doc_id").alias(id_), r1, r2).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("epochs") + (F.col("taken") > 0).cast("long")).alias("all"))
    many = materialise(each.filter(F.col("all") != F.col("rows")).select(id_, F.col(r1).alias(f"{r1}_"), F.col(r2).alias(f"{r2}_"), "all", "rows"))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(r1) == F.col(f"{r1}_")) & (F.col(r2) == F.col(f"{r2}_"))

    def bounded(side: DataFrame) -> DataFrame:
        return F.broadcast(side) if side.count() <= 1_000_000 else side  # four longs each

    even = many.select(id_, f"{r1}_", f"{r2}_", F.when(F.col("all") % F.col("rows") == 0, F.expr("all div rows")).otherwise(0).alias(times))
    out = rows.join(bounded(even), same, "left").withColumn(times, F.coalesce(times, F.lit(1).cast("long"))).filter(F.col(times) > 0)
    out = out.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)
    uneven = many.filter("all % rows <> 0").select(id_, f"{r1}_", f"{r2}_", F.col("all").alias(times))
    if uneven.isEmpty():
        return out
    one = rows.join(bounded(uneven), same).groupBy("doc_id", r1, r2, times).agg(F.first(F.struct(*docs.columns)).alias(row))
    return out.unionByName(one.select(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(f"{row}.*"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return plan(materialise(keys_of(read_table(spark, sf_dir, "documents"))))


def _level(name: str, table: str, parent: str, total: str) -> str:
    """DuckDB: ``table`` (parent columns, name, capacity, weight, total) with share."""
    over = f"PARTITION BY {parent}" if parent else ""
    keys = f"{parent}, " if parent else ""
    return f"""
{name}_a AS (
  SELECT *, coalesce(sum(capacity) OVER ({over} ORDER BY capacity::DOUBLE / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
    sum(weight) OVER ({over} ORDER BY capacity::DOUBLE / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS onward FROM {table}
), {name}_b AS (
  SELECT *, capacity::HUGEINT * onward <= weight::HUGEINT * ({total} - before) AS filled FROM {name}_a
), {name}_c AS (
  SELECT *, {total} - coalesce(sum(capacity) FILTER (filled) OVER ({over}), 0)::HUGEINT AS rest, sum(weight) FILTER (NOT filled) OVER ({over})::HUGEINT AS rest_weight FROM {name}_b
), {name}_d AS (
  SELECT *, CASE WHEN NOT filled THEN rest * weight // rest_weight END AS part FROM {name}_c
), {name}_e AS (
  SELECT *, row_number() OVER ({over} ORDER BY filled, {name}) AS place, rest - sum(part) OVER ({over})::HUGEINT AS spare FROM {name}_d
), {name}_f AS (
  SELECT {keys}{name}, CASE WHEN filled THEN capacity ELSE part + CASE WHEN place <= spare THEN 1 ELSE 0 END END::BIGINT AS share FROM {name}_e
)"""


def _case(name: str, weights: dict[str, int]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END::BIGINT"


OP3_SQL = rf"""
WITH k AS (
  SELECT doc_id, {DOMAIN} AS domain, coalesce(lang, '-') AS lang, coalesce(source, '-') AS source,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens FROM documents
), leaf AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS n, sum(n_tokens)::BIGINT * {MAX_EPOCHS} AS capacity FROM k GROUP BY ALL HAVING sum(n_tokens) > 0
), t1 AS (
  SELECT domain, sum(capacity)::BIGINT AS capacity, {_case("domain", DOMAIN_WEIGHTS)} AS weight, (SELECT sum(n)::BIGINT * {SHARE} // 1000 FROM leaf) AS total FROM leaf GROUP BY domain
), {_level("domain", "t1", "", "total")}, t2 AS (
  SELECT leaf.domain, lang, sum(capacity)::BIGINT AS capacity, {_case("lang", LANG_WEIGHTS)} AS weight, any_value(share) AS total FROM leaf JOIN domain_f USING (domain) GROUP BY ALL
), {_level("lang", "t2", "domain", "total")}, t3 AS (
  SELECT leaf.domain, leaf.lang, source, capacity, {_case("source", SOURCE_WEIGHTS)} AS weight, share AS total FROM leaf JOIN lang_f ON leaf.domain = lang_f.domain AND leaf.lang = lang_f.lang
), {_level("source", "t3", "domain, lang", "total")}, b AS (
  SELECT k.*, coalesce(share, 0) AS budget, coalesce(share // n, 0)::BIGINT AS epochs, coalesce(share % n, 0) AS left_over
  FROM k LEFT JOIN leaf USING (domain, lang, source) LEFT JOIN source_f USING (domain, lang, source)
), o AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}|' || epochs || '|' || coalesce(doc_id::VARCHAR, '-')), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM b
)
SELECT doc_id, domain, lang, source, n_tokens, budget, epochs, greatest(0, least(n_tokens, left_over - ahead))::BIGINT AS taken FROM o
"""

"""Generation of sentences for many prompts at once: plan a code tuple, draw candidates, rank them again, go on.

A step plans the likeliest tuple of each prompt, draws ``n_cand`` tuples from the planner's distributions, cut to the
likeliest codes of a share ``top_p``, and takes for each draw the library sentence with the most equal codes. Of the
candidates, the one whose codes agree most with the planned tuple is appended; the earliest of equals.

Draws are races: each code of weight w has the time -ln(u) / w, with u from the md5 of seed, step, prompt, candidate, place and
code, and the first one is drawn. So a code is drawn as often as its weight says, and a step that runs again draws the same.

The library is met through an index: one row for each combination of places and their codes, with the first text that has
them. A draw looks up its own combinations, and each gives one row at most, however many sentences share the codes.
Every step is written, and the next one reads it: plans don't grow with steps.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import codes as K
from quillspark.functions import text as T
from quillspark.models.planner import Encoder, embed
from quillspark.operators import rvq
from quillspark.operators.tables import written


@dataclass(frozen=True)
class Settings:
    """What a call may override. Without rerank one candidate is drawn; without do_sample all are the planned tuple."""

    n_cand: int = 4
    rerank: bool = True
    do_sample: bool = True
    top_p: float = 0.9
    temp: float = 0.8
    context_sents: int = 6
    save_candidates: bool = False
    seed: int = 0

    def with_overrides(self, **given) -> Settings:
        if unknown := sorted(set(given) - {f.name for f in fields(self)}):
            raise ValueError(f"Unknown generate() params: {', '.join(unknown)}")
        return replace(self, **given)


def distributions(rows: DataFrame, k: int, temp: float = 1.0, top_p: float = 1.0) -> DataFrame:
    """(head, ctx, pred, options): after the last context code ctx (null: after any), the likeliest code, and codes with
    weights n^(1/temp), by weight and code, as far as these before a code have less than top_p of all.

    rows: ctx_codes, tgt_codes. A row of options has at most as many entries as a stage has codes.
    """
    each = rows.select(F.posexplode(F.arrays_zip(F.slice("ctx_codes", F.size("ctx_codes") - k + 1, F.lit(k)).alias("c"), F.col("tgt_codes").alias("t"))).alias("head", "x"))
    counts = each.groupBy("head", F.col("x.c").alias("ctx"), F.col("x.t").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.unionByName(counts.groupBy("head", "code").agg(F.sum("n").alias("n")).withColumn("ctx", F.lit(None).cast("int")))
    counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(1.0 / temp)))
    group = Window.partitionBy("head", "ctx")
    before = F.coalesce(F.sum("w").over(group.orderBy(F.desc("n"), "code").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = counts.withColumn("before", before).withColumn("all", F.sum("w").over(group)).filter(F.col("before") < F.lit(top_p) * F.col("all"))
    packed = kept.groupBy("head", "ctx").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "code", "w"))).alias("o"))
    return packed.select("head", "ctx", F.col("o")[0]["code"].alias("pred"), F.transform("o", lambda x: F.struct(x["code"].alias("code"), x["w"].alias("w"))).alias("options"))


def library_index(library: DataFrame, k: int) -> DataFrame:
    """(key, text, codes) from (text, codes): for each combination of one or more places and their codes, the first text
    with these. 2^k - 1 rows a distinct tuple before they are combined in the task.
    """
    one = library.groupBy("codes").agg(F.min("text").alias("text"))
    keys = one.select("text", "codes", F.explode(_keys(F.col("codes"), k)).alias("key"))
    return keys.groupBy("key").agg(F.min(F.struct("text", "codes")).alias("x")).select("key", "x.*")


def _keys(codes: Column, k: int) -> Column:
    """A tuple with its places blanked out in all ways but the one that blanks all."""
    masks = F.sequence(F.lit(1), F.lit((1 << k) - 1))
    return F.transform(masks, lambda m: F.concat_ws("|", F.transform(codes, lambda c, i: F.when(F.call_function("shiftright", m, i).bitwiseAND(1) == 1, c.cast("string")).otherwise("_"))))


def _uniform(*parts: Column | str | int) -> Column:
    """From 0 to 1, both excluded: the first 48 bits of the md5 of the parts."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _race(options: Column, *parts: Column | str | int) -> Column:
    """The drawn code of an array of (code, w)."""
    times = F.transform(options, lambda o: F.struct((-F.log(_uniform(*parts, o["code"])) / o["w"]).alias("t"), o["code"].alias("code")))
    return F.array_min(times)["code"]


def planned(state: DataFrame, planner: DataFrame, k: int, step: int, how: Settings) -> DataFrame:
    """(prompt_id, ctx_codes, pred_codes, draws: array of tuples)."""
    n = how.n_cand if how.rerank else 1
    each = state.select("prompt_id", F.posexplode(F.slice("ctx_codes", F.size("ctx_codes") - k + 1, F.lit(k))).alias("head", "ctx"))
    seen = planner.filter("ctx is not null")
    any_ctx = planner.filter("ctx is null").select("head", F.col("pred").alias("any_pred"), F.col("options").alias("any_options"))  # k rows
    each = each.join(seen, ["head", "ctx"], "left").join(F.broadcast(any_ctx), "head")
    each = each.select("prompt_id", "head", F.coalesce("pred", "any_pred").alias("pred"), F.coalesce("options", "any_options").alias("options"))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: _race(F.col("options"), how.seed, step, F.col("prompt_id"), c, F.col("head")) if how.do_sample else F.col("pred"))
    tuples = each.select("prompt_id", F.struct("head", "pred", drawn.alias("drawn")).alias("x")).groupBy("prompt_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    tuples = tuples.select("prompt_id", F.col("x.pred").alias("pred_codes"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.transform("x", lambda h: F.get(h["drawn"], c))).alias("draws"))
    return state.join(tuples, "prompt_id")


def generate(prompts: DataFrame, rows: DataFrame, library: DataFrame, k: int, max_sentences: int = 6, settings: Settings = Settings(), **overrides) -> DataFrame:
    """(prompt_id, step from 1, pred_codes, text, match, match_str and, if saved, candidates (text, score)).

    prompts: prompt_id, ctx_codes (of the context's sentences). rows: ctx_codes, tgt_codes, which the planner counts.
    library: text, codes. Overrides that Settings lacks are an error. An empty library gives no rows.
    """
    how = settings.with_overrides(**overrides)
    planner = written(distributions(rows, k, how.temp, how.top_p))
    index = written(library_index(library, k))
    first = library.agg(F.min(F.struct("text", "codes")).alias("x")).select(F.col("x.text").alias("any_text"), F.col("x.codes").alias("any_codes"))  # one row, for draws that share no code
    first = written(first.filter("any_text is not null"))
    state, steps = prompts.select("prompt_id", "ctx_codes"), []
    for step in range(1, max_sentences + 1):
        plans = written(planned(state, planner, k, step, how))
        draws = plans.select("prompt_id", F.posexplode("draws").alias("cand", "codes"))
        keys = draws.select("prompt_id", "cand", F.posexplode(_keys(F.col("codes"), k)).alias("mask", "key"))
        found = keys.join(index, "key").select("prompt_id", "cand", F.struct((-F.bit_count(F.col("mask") + 1)).alias("less"), "text", "codes").alias("x"))
        found = found.groupBy("prompt_id", "cand").agg(F.min("x").alias("x"))
        made = draws.select("prompt_id", "cand").join(found, ["prompt_id", "cand"], "left").crossJoin(F.broadcast(first))  # one row
        made = made.select("prompt_id", "cand", F.coalesce("x.text", "any_text").alias("text"), F.coalesce("x.codes", "any_codes").alias("codes"))
        made = made.join(plans.select("prompt_id", "pred_codes"), "prompt_id").withColumn("score", K.match_score(F.col("codes"), F.col("pred_codes")))
        all_of = F.transform(F.array_sort(F.collect_list(F.struct("cand", "text", "score"))), lambda x: F.struct(x["text"].alias("text"), x["score"].alias("score")))
        best = made.groupBy("prompt_id").agg(F.min_by(F.struct("text", "codes", "score"), F.struct((-F.col("score")).alias("less"), "cand")).alias("b"), all_of.alias("candidates"))
        best = best.join(plans.select("prompt_id", "ctx_codes", "pred_codes"), "prompt_id")
        grown = F.concat("ctx_codes", "b.codes")
        size = k * how.context_sents
        done = best.select(
            "prompt_id", F.lit(step).alias("step"), "pred_codes", F.col("b.text").alias("text"), F.col("b.score").alias("match"), F.concat(F.col("b.score").cast("string"), F.lit(f"/{k}")).alias("match_str"), "candidates",
            F.slice(grown, F.greatest(F.lit(1), F.size(grown) - size + 1), F.lit(size)).alias("ctx_codes"),
        )
        steps.append(written(done))
        state = steps[-1].select("prompt_id", "ctx_codes")
    schema = ["prompt_id", "step", "pred_codes", "text", "match", "match_str"] + ["candidates"] * how.save_candidates
    out = steps[0].select(*schema) if steps else None
    for one in steps[1:]:
        out = out.unionByName(one.select(*schema))
    if out is None:
        raise ValueError("max_sentences must be positive")
    return out


def continued(prompts: DataFrame, text: str, steps: DataFrame) -> DataFrame:
    """``prompts`` with the column ``generated``: the text, and after it the sentences of all steps, a space before each."""
    said = steps.groupBy("prompt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "text"))), lambda x: x["text"]).alias("__said"))
    out = prompts.join(said, "prompt_id", "left")
    return out.withColumn("generated", F.array_join(F.concat(F.array(F.rtrim(F.coalesce(text, F.lit("")))), F.coalesce("__said", F.array().cast("array<string>"))), " ")).drop("__said")


def prompt_contexts(prompts: DataFrame, text: str, encoder: Encoder, book: np.ndarray, context: int = 6) -> DataFrame:
    """(prompt_id, ctx_codes) of prompts with a text: its last sentences of 5 characters or more, the first one repeated
    before them if there are too few, each embedded and encoded. A prompt without such a sentence is an error.
    """
    sentences = T.inference_sentences(F.col(text))
    if prompts.filter(F.coalesce(F.size(sentences), F.lit(0)) < 1).limit(1).count():
        raise ValueError("Prompt must contain at least one sentence with 5+ characters.")
    each = prompts.select("prompt_id", F.posexplode(K.pad_left(sentences, context)).alias("place", "sentence"))
    coded = rvq.encode(embed(each, "sentence", encoder), "embedding", book)
    packed = coded.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("place", "codes"))).alias("x"))
    return packed.select("prompt_id", F.flatten("x.codes").alias("ctx_codes"))

"""Merging machine labels with human ones, and exporting them beside the frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EVENT, PERSISTENT

# The styles that depend on the view.
VIEW = ("vqa", "trace")


def is_auto(style: Column, content: Column, origin: Column) -> Column:
    """Machine-made: an interjection that begins with ``[auto:``, or a subtask of origin auto."""
    return F.coalesce(((style == "interjection") & content.startswith("[auto:")) | ((style == "subtask") & (origin == "auto")), F.lit(False))


def is_interpretation(content: Column) -> Column:
    return F.coalesce(content.rlike(r"^\[auto:\w+\] (finger_unload|sensor_residual|phantom)\b"), F.lit(False))


def merge(kept: DataFrame, made: DataFrame, key: str, verified: bool = True) -> DataFrame:
    """Human atoms stay, machine ones are replaced by the new; a new subtask goes where a human one
    of the episode has its text; without a verified profile interpretations go."""
    human = kept.filter(~is_auto(F.col("style"), F.col("content"), F.col("origin")))
    taken = human.filter("style = 'subtask'").select(key, "style", "content").distinct()
    new = made.join(taken, [key, "style", "content"], "left_anti").select(made.columns)
    if not verified:
        new = new.filter(~is_interpretation(F.col("content")))
    return human.unionByName(new)


def with_language(frames: DataFrame, atoms: DataFrame, key: str, t: str) -> DataFrame:
    """Frames with two array columns: the episode's persistent atoms on every frame, and events on
    the frame nearest to them (the earlier on ties)."""
    from . import asof

    persistent = atoms.filter("style in ('subtask', 'memory', 'plan')").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("timestamp"), "style", "role", "content"))).alias("language_persistent"))
    events = atoms.filter("style not in ('subtask', 'memory', 'plan')")
    spot = asof.nearest(events, frames.select(key, t).withColumn("_f", F.col(t)), [key], t, "_f", "_at")
    spot = spot.groupBy(key, F.col("_at").alias(t)).agg(F.array_sort(F.collect_list(F.struct("style", "role", "content"))).alias("language_events"))
    out = frames.join(persistent, key, "left").join(spot, [key, t], "left")
    return out.withColumn("language_persistent", F.coalesce("language_persistent", F.array())).withColumn("language_events", F.coalesce("language_events", F.array()))


def flagged_ids(flags: DataFrame, key: str) -> DataFrame:
    """(kind, ids): the episodes of each flag as one text, in order."""
    return flags.select("kind", key).distinct().groupBy("kind").agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_set(key)), lambda x: x.cast("string"))).alias("ids"))


#: Of an old annotation document: timed labels, and prompts with what was said in answer.
LEGACY = "struct<subtasks:array<struct<label:string,start:double>>,high_levels:array<struct<start:double,user_prompt:string,robot_utterance:string>>>"
CALL = "array<struct<type:string,function:struct<name:string,arguments:struct<text:string>>>>"


def upgraded(docs: DataFrame, key: str, document: str) -> DataFrame:
    """(key, timestamp, role, style, content, tool_calls) from old documents: subtasks with a label and a
    start, prompts as interjections, utterances as say calls; empty prompts and utterances give nothing."""
    d = docs.withColumn("_d", F.from_json(document, LEGACY))
    none = F.lit(None).cast("string")
    sub = d.select(key, F.explode("_d.subtasks").alias("s")).filter("s.label is not null and s.start is not null")
    sub = sub.select(key, F.col("s.start").alias("timestamp"), F.lit("assistant").alias("role"), F.lit("subtask").alias("style"), F.col("s.label").alias("content"), F.lit(None).cast(CALL).alias("tool_calls"))
    # one pass over the high levels: each gives up to two atoms
    high = d.select(key, F.explode("_d.high_levels").alias("s")).select(key, F.coalesce("s.start", F.lit(0.0)).alias("timestamp"), F.col("s.user_prompt").alias("ask"), F.col("s.robot_utterance").alias("say"))
    row = lambda on, role, style, content, call: F.when(F.length(on) > 0, F.struct(F.lit(role).alias("role"), style.alias("style"), content.alias("content"), call.alias("tool_calls")))
    both = F.array_compact(F.array(row(F.col("ask"), "user", F.lit("interjection"), F.col("ask"), F.lit(None).cast(CALL)), row(F.col("say"), "assistant", none, none, say_call(F.col("say")))))
    return sub.unionByName(high.select(key, "timestamp", F.explode(both).alias("a")).select(key, "timestamp", "a.*"))


def say_call(text: Column) -> Column:
    """The tool calls of a speech atom."""
    return F.array(F.struct(F.lit("function").alias("type"), F.struct(F.lit("say").alias("name"), F.struct(text.alias("text")).alias("arguments")).alias("function"))).cast(CALL)


def speech_text(role: Column, style: Column, tool_calls: Column) -> Column:
    """What a speech atom says: an assistant's atom without a style whose first call is ``say``; else null."""
    call = F.get(tool_calls, 0)["function"]
    return F.when(style.isNull() & (role == "assistant") & (call["name"] == "say"), call["arguments"]["text"])


def fault(style: Column, content: Column, n_calls: Column, camera: Column) -> Column:
    """Why an atom is refused, null where it is fine: an unknown style, neither content nor calls, no
    style without calls, or a camera on a style that does not depend on the view."""
    calls = F.coalesce(n_calls, F.lit(0)) > 0
    reasons = F.when(~style.isin(*PERSISTENT, *EVENT), "style").when(content.isNull() & ~calls, "empty").when(style.isNull() & ~calls, "speech")
    return reasons.when((F.length(camera) > 0) & ~style.isin(*VIEW), "camera")


def seen_by(atoms: DataFrame, cameras: list[str], camera: str = "camera") -> DataFrame:
    """Each camera's atoms: its own, and those without a camera. ``cameras``: the few that a dataset names."""
    names = F.array(*[F.lit(c) for c in cameras])
    shown = F.when(F.col(camera).isNull(), names).otherwise(F.filter(names, lambda c: c == F.col(camera)))
    return atoms.withColumn("_c", F.explode(shown)).withColumn(camera, F.col("_c")).drop("_c")


def cleared(atoms: DataFrame, edited: Column) -> DataFrame:
    """Atoms whose edited ones have lost their origin: they are a person's from then on."""
    return atoms.withColumn("origin", F.when(~F.coalesce(edited, F.lit(False)), F.col("origin")))


def _set(atoms: DataFrame, key: str, columns, out: str) -> DataFrame:
    """(key, out): a digest of each episode's multiset of atoms; rows with null in all columns stand for an empty one."""
    real = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
    h = F.when(real, F.xxhash64(*columns).cast("decimal(38,0)"))
    g = F.when(real, F.xxhash64(F.lit(7), *columns).cast("decimal(38,0)"))
    return atoms.groupBy(key).agg(F.struct(F.count(h).alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("a"), F.coalesce(F.sum(g), F.lit(0)).alias("b")).alias(out))


def local_edits(local: DataFrame, hub: DataFrame, merged: DataFrame, staged: DataFrame, key: str, columns) -> DataFrame:
    """(key, edited) of each episode with a local copy: whether it differs, as a multiset, from what the
    hub holds, from the new proposal and from what was staged before (where anything was). A copy
    that was emptied is one row of nulls, and counts as edited where the others hold atoms."""
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("a"), F.lit(0).cast("decimal(38,0)").alias("b"))
    d = _set(local, key, columns, "l")
    for name, df in (("h", hub), ("m", merged), ("s", staged)):
        d = d.join(_set(df, key, columns, name), key, "left")
    other = lambda c: F.col("l") != c
    return d.select(key, (other(F.coalesce("h", empty)) & other(F.coalesce("m", empty)) & F.coalesce(other(F.col("s")), F.lit(True))).alias("edited"))


def commit_entries(report: DataFrame, local: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, origin, atoms) of staged episodes that are not committed yet: the local copy, else the
    run's file, else ``missing``."""
    d = report.filter("staged and not coalesce(committed, false)").select(key)
    d = d.join(local.select(key, F.col("atoms").alias("_l")), key, "left").join(files.select(key, F.col("atoms").alias("_f")), key, "left")
    return d.select(key, F.when(F.col("_l").isNotNull(), "local").when(F.col("_f").isNotNull(), "file").otherwise("missing").alias("origin"), F.coalesce("_l", "_f").alias("atoms"))


def reviewed(current: DataFrame, entries: DataFrame, key: str, columns, overwrite: bool = False) -> DataFrame:
    """Reviews after automatic entries: one replaces an automatic review or none; a person's stays unless
    ``overwrite``. ``written`` says whose is new."""
    e = entries.select(key, F.struct(*columns).alias("_e"))
    c = current.select(key, "source", F.struct(*columns).alias("_c"))
    new = F.col("_e").isNotNull() & (F.col("_c").isNull() | F.coalesce(F.col("source") == "auto", F.lit(False)) | F.lit(overwrite))
    d = c.join(e, key, "full").withColumn("written", new)
    return d.select(key, F.when(F.col("written"), F.col("_e")).otherwise(F.col("_c")).alias("_r"), F.when(F.col("written"), "auto").otherwise(F.col("source")).alias("source"), "written").select(key, "_r.*", "source", "written")

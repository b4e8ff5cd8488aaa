"""Chat formatting: heterogeneous layouts to canonical turns, then to one marked string.

A layout is known by its fingerprint, the SHA-256 of its sorted nested field paths. Each
fingerprint selects a declarative mapping (``LAYOUTS``); nothing inspects values to guess.
Tables are fingerprinted by their schema, JSON payloads row by row through Spark's variant
type. Only DataFrame functions are used.

Defined results: null role or text is empty (a null field of a layout with one field per turn is
no turn); a null turn number sorts first; rows with the same
turn number sort by role and text; repeated rows are repeated turns; a null or unmatched payload
gives no turn (``unmatched`` lists those rows); other columns are ignored; an empty table gives
an empty result. One conversation is one output record, so its turns meet in one row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

# Control strings of common chat templates, escaped inside texts.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")

#: Layouts by name: the field paths that identify one, and how it maps to turns. ``turns`` are
#: (role, path) pairs in order with literal roles; ``list`` is a path to an array of messages.
LAYOUTS = {
    "turn_rows": {"paths": ("conv_id", "role", "text", "turn"), "row": ("turn", "role", "text")},
    "messages": {"paths": ("messages", "messages[].content", "messages[].role"), "list": ("messages", "role", "content")},
    "conversations": {"paths": ("conversations", "conversations[].from", "conversations[].value"), "list": ("conversations", "from", "value")},
    "prompt_response": {"paths": ("prompt", "response"), "turns": (("user", "prompt"), ("assistant", "response"))},
    "prompt_completion": {"paths": ("completion", "prompt"), "turns": (("user", "prompt"), ("assistant", "completion"))},
    "system_prompt_response": {"paths": ("prompt", "response", "system"), "turns": (("system", "system"), ("user", "prompt"), ("assistant", "response"))},
    "instruction": {"paths": ("input", "instruction", "output"), "turns": (("user", "instruction"), ("user", "input"), ("assistant", "output"))},
    "instruction_short": {"paths": ("instruction", "output"), "turns": (("user", "instruction"), ("assistant", "output"))},
}
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


BY_PRINT = {fingerprint(spec["paths"]): name for name, spec in LAYOUTS.items()}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """All nested field paths of a type; array elements are marked by ``[]``."""
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    if not isinstance(kind, T.StructType):
        return []
    out = []
    for f in kind.fields:
        path = f"{at}.{f.name}" if at else f.name
        out += [path, *field_paths(f.dataType, path)]
    return out


def layout_of(df: DataFrame, id_col: str = "conv_id") -> str | None:
    """The layout whose fingerprint is that of the table, with or without its id column."""
    paths = field_paths(df.schema)
    for own in (paths, [p for p in paths if p != id_col]):
        if name := BY_PRINT.get(fingerprint(own)):
            return name
    return None


def _canonical(role: Column) -> Column:
    out = F.coalesce(role.cast("string"), F.lit(""))
    for old, new in ROLES.items():
        out = F.when(role == old, new).otherwise(out)
    return out


def _from_arrays(df: DataFrame, id_col: str, msgs: Column) -> DataFrame:
    rows = df.select(F.col(id_col).alias("conv_id"), F.posexplode(msgs).alias("turn", "m"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _canonical(F.col("m.role")).alias("role"), F.coalesce("m.text", F.lit("")).alias("text"))


def _renamed(msgs: Column, role: str, text: str) -> Column:
    return F.transform(msgs, lambda m: F.struct(m[role].alias("role"), m[text].alias("text")))


def turns(df: DataFrame, layout: str | None = None, id_col: str = "conv_id") -> DataFrame:
    """Canonical (conv_id, turn, role, text) rows of a table of one layout, found by its fingerprint.

    Pass ``layout`` where the table has more columns than the layout names.
    """
    name = layout or layout_of(df, id_col)
    if name is None:
        raise ValueError(f"no layout has the fingerprint of {field_paths(df.schema)}")
    spec = LAYOUTS[name]
    if "row" in spec:
        turn, role, text = spec["row"]
        return df.select(F.col(id_col).alias("conv_id"), F.col(turn).cast("long").alias("turn"), _canonical(F.col(role)).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if "list" in spec:
        at, role, text = spec["list"]
        return _from_arrays(df, id_col, _renamed(F.col(at), role, text))
    pairs = [F.struct(F.lit(role).alias("role"), F.col(path).alias("text")) for role, path in spec["turns"]]
    return _from_arrays(df, id_col, F.filter(F.array(*pairs), lambda m: m["text"].isNotNull()))


def payload_layout(payload: Column) -> Column:
    """The layout name of each JSON payload, null where none matches: the row's own schema is
    reduced to its nested field names, hashed, and looked up."""
    kind = F.schema_of_variant(F.try_parse_json(payload))
    names = F.regexp_replace(kind, r": (?!OBJECT|ARRAY)[A-Z]+(?:\([0-9,]+\))?", "")
    shapes = {name: _variant_shape(spec["paths"]) for name, spec in LAYOUTS.items() if "row" not in spec}
    return F.coalesce(*[F.when(F.sha2(names, 256) == hashlib.sha256(s.encode()).hexdigest(), name) for name, s in shapes.items()])


def _variant_shape(paths) -> str:
    tops = sorted(p for p in paths if "[]" not in p)
    inner = lambda top: ", ".join(sorted(p.split("[].")[1] for p in paths if p.startswith(f"{top}[].")))
    return "OBJECT<" + ", ".join(f"{t}: ARRAY<OBJECT<{inner(t)}>>" if inner(t) else t for t in tops) + ">"


def payload_turns(df: DataFrame, payload: str, id_col: str = "conv_id") -> DataFrame:
    """Canonical turns of JSON payloads whose layouts differ from row to row."""
    v = F.try_parse_json(F.col(payload))
    one = "array<struct<role:string,text:string>>"
    msgs = F.lit(None).cast(one)
    for name, spec in LAYOUTS.items():
        if "list" in spec:
            at, role, text = spec["list"]
            found = F.try_variant_get(v, f"$.{at}", f"array<struct<`{role}`:string,`{text}`:string>>")
            got = _renamed(found, role, text)
        elif "turns" in spec:
            got = F.array(*[F.struct(F.lit(role).alias("role"), F.try_variant_get(v, f"$.{path}", "string").alias("text")) for role, path in spec["turns"]])
            got = F.filter(got, lambda m: m["text"].isNotNull())
        else:
            continue
        msgs = F.when(F.col("_layout") == name, got.cast(one)).otherwise(msgs)
    return _from_arrays(df.withColumn("_layout", payload_layout(F.col(payload))), id_col, msgs)


def unmatched(df: DataFrame, payload: str) -> DataFrame:
    """Rows whose payload has no known layout."""
    return df.filter(payload_layout(F.col(payload)).isNull())


def escape(text: Column) -> Column:
    """Double each backslash, then put one after the first character of each control string."""
    out = F.regexp_replace(text, r"\\", r"\\\\")
    for first, mark in (("<", "<"), ("[", r"\[")):
        rest = "|".join(c[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in CONTROL if c[0] == first)
        out = F.regexp_replace(out, f"{mark}({rest})", first + r"\\$1")
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(rows: DataFrame) -> DataFrame:
    """One record per conversation: conv_id, formatted, loss_spans (code-point ranges of the
    assistants' texts in ``formatted``, end exclusive)."""
    role = F.regexp_replace(escape(F.col("role")), "\n", "\\\\\n")
    r = rows.select("conv_id", "turn", "role", "text", role.alias("_r"), escape(F.col("text")).alias("_t"))
    r = r.withColumn("_piece", F.concat(F.lit("<|im_start|>"), "_r", F.lit("\n"), "_t", F.lit("<|im_end|>\n")))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    r = r.select("conv_id", "role", "_piece", F.length("_t").alias("_n"), F.row_number().over(w).alias("_i"), F.sum(F.length("_piece")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_end"))
    stop = F.col("_end") - len("<|im_end|>\n")
    span = F.when(F.col("role") == "assistant", F.struct((stop - F.col("_n")).alias("start"), stop.alias("end")))
    out = r.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_i", "_piece"))).alias("p"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return out.select("conv_id", F.concat_ws("", F.col("p._piece")).alias("formatted"), "loss_spans")


def parsed(out: DataFrame) -> DataFrame:
    """Read formatted records back: conv_id, turns array of (role, text), loss_text, formatted_chars."""
    pat = r"(?s)<\|im_start\|>((?:[^\\\n]|\\.)*+)\n(.*?)<\|im_end\|>\n"
    got = lambda k: F.transform(F.regexp_extract_all("formatted", F.lit(pat), F.lit(k)), unescape)
    under = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    zipped = F.arrays_zip(got(1).alias("role"), got(2).alias("text"))
    return out.select("conv_id", zipped.alias("turns"), F.concat_ws("", under).alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, read back and digested."""
    said = "</s>[INST] ok [/INST]"
    own = f'{{"messages": [{{"role": "user", "content": "{said}"}}, {{"role": "assistant", "content": "{said}"}}]}}'
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(own).alias("payload"))
    rows = turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).unionByName(payload_turns(more, "payload"))
    back = parsed(formatted(rows))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


_ESC = "regexp_replace(regexp_replace(replace({0}, '\\', '\\\\'), '<(\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|s>|/s>|<SYS>>|</SYS>>)', '<\\\\\\1', 'g'), '\\[(INST\\]|/INST\\])', '[\\\\\\1', 'g')"
ORACLE = f"""
WITH rows0 AS (
  SELECT conv_id, turn, CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE coalesce(role, '') END AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || replace({_ESC.format('role')}, chr(10), '\\' || chr(10)) || chr(10) || {_ESC.format('text')} || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM rows0 GROUP BY conv_id
"""

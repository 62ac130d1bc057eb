"""Reply trees formatted as conversations, with a loss mask over what the assistant says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm.storage import fresh, written

#: The template's own marks, fixed values: a turn is START role MIDDLE text STOP.
START, MIDDLE, STOP = "<|turn|>", "<|says|>", "<|done|>"
#: Strings that some chat template or tokenizer gives a meaning to; inside texts they are escaped. Fixed values.
CONTROL = (
    START, MIDDLE, STOP, "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>",
    "<|begin_of_text|>", "<|end_of_text|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>", "<bos>", "<eos>",
)
_ANY = "|".join(rf"(?<=\Q{c[0]}\E)(?=\Q{c[1:]}\E)" for c in CONTROL)

def escaped(text: Column) -> Column:
    r"""Backslashes are doubled, and one goes after the first character of each control string; nothing else changes."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _ANY, r"\\")


def unescaped(text: Column) -> Column:
    """A backslash stands for what follows it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame) -> DataFrame:
    """Root-to-leaf paths of (conv, node, parent) as rows (conv, leaf, node, steps), steps counted from the leaf up.

    Round i joins what is known of each leaf's ancestors to the jumps of 2**i steps, and the jumps to themselves, so a tree of
    depth d takes log2(d) rounds, and the rows of all rounds together are those of the result and the jumps still inside a tree.
    A node whose parent is null or absent is a root.  Nodes on a cycle reach no root; paths that end there are left out.
    """
    known = messages.select("conv", F.col("node").alias("parent")).distinct()
    linked = messages.select("conv", "node", "parent").join(known, ["conv", "parent"]).select("conv", "node", F.col("parent").alias("up"))
    jumps = linked = written(linked, "jumps")
    leaves = messages.select("conv", "node").join(linked.select("conv", F.col("up").alias("node")).distinct(), ["conv", "node"], "left_anti")
    found = written(leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("steps")), "paths")
    most, reach = messages.count(), 1
    while reach <= most and not jumps.isEmpty():
        more = found.join(jumps, ["conv", "node"]).select("conv", "leaf", F.col("up").alias("node"), (F.col("steps") + reach).alias("steps"))
        found = found.union(written(more, "paths"))
        further = jumps.select("conv", F.col("node").alias("up"), F.col("up").alias("next"))
        jumps = written(jumps.join(further, ["conv", "up"]).select("conv", "node", F.col("next").alias("up")), "jumps")
        reach *= 2
    ends = found.groupBy("conv", "leaf").agg(F.max_by("node", "steps").alias("node"))
    rooted = ends.join(linked.select("conv", "node"), ["conv", "node"], "left_anti").select("conv", "leaf")
    return found.join(rooted, ["conv", "leaf"], "left_semi")


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Format the ``branches`` best root-to-leaf paths of each tree.

    ``messages`` has conv, node (unique in its conv, not null), parent, role, text, score; a path's score is the mean of its
    messages' scores (a null counts as 0), and ties go to the smaller leaf.  Returns conv, branch (1 is the best), leaf,
    formatted, and loss: (begin, length) in characters of each assistant text within ``formatted``.
    Null texts and roles are empty; empty texts keep their turn; an empty table gives no rows.
    One conversation's chosen branches are rows of their own, so the largest thing in one task is one formatted conversation.
    """
    steps = paths(messages).withColumn("place", -F.col("steps"))
    c = F.col
    full = steps.join(messages.select("conv", "node", "role", "text", "score"), ["conv", "node"])
    best = full.groupBy("conv", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
    best = best.withColumn("branch", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), "leaf"))).where(c("branch") <= branches)

    said = full.join(best.select("conv", "leaf", "branch"), ["conv", "leaf"])
    said = said.withColumns({"head": F.concat(F.lit(START), escaped(F.coalesce("role", F.lit(""))), F.lit(MIDDLE)), "text": escaped(F.coalesce("text", F.lit("")))})
    before = Window.partitionBy("conv", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("head") + F.length("text") + len(STOP)).over(before), F.lit(0)) + F.length("head")
    said = said.withColumn("begin", begin.cast("int"))
    turn = F.struct("place", F.concat("head", "text", F.lit(STOP)).alias("whole"), F.when(c("role") == "assistant", F.struct("begin", F.length("text").alias("length"))).alias("loss"))
    told = said.groupBy("conv", "leaf", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return told.select(
        "conv", "branch", "leaf", F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["loss"]), lambda s: s.isNotNull()).alias("loss"),
    )


def parsed_turns(formatted: Column) -> Column:
    """(role, text) of each turn of a formatted conversation."""
    blocks = F.filter(F.split(formatted, rf"\Q{STOP}\E"), lambda b: b != "")
    part = lambda b, i: unescaped(F.get(F.split(F.substr(b, F.lit(len(START) + 1)), rf"\Q{MIDDLE}\E"), i))
    return F.transform(blocks, lambda b: F.struct(part(b, 0).alias("role"), part(b, 1).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, s["begin"] + 1, s["length"]))), "")


def op9_reply_trees(spark, sf_dir: str) -> DataFrame:
    """Every conversation as a chain of its rows by turn, and conversation -1."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], rows.schema))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    # a null conversation id is a conversation too: the key keeps it apart from every number
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    messages = rows.select(key.alias("conv"), nth.alias("node"), (nth - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    out = fresh(spark, "chat")
    format_trees(written(messages, "messages")).write.parquet(out)
    read = spark.read.parquet(out).withColumn("turns", parsed_turns(F.col("formatted"))).withColumn("said", loss_text(F.col("formatted"), F.col("loss")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.when(F.col("conv") != "none", F.col("conv").cast("long")).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_CONTROL_RE = "|".join("".join("\\" + x if x in "<|>[]/" else x for x in c) for c in CONTROL)
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text) + {len(START + MIDDLE + STOP)}
    + len(regexp_extract_all(role, '\\\\')) + len(regexp_extract_all(text, '\\\\'))
    + len(regexp_extract_all(role, '{_CONTROL_RE}')) + len(regexp_extract_all(text, '{_CONTROL_RE}')) AS n
  FROM c
), a AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '') AS said, sum(n)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(said)::BIGINT AS loss_chars, sha256(said) AS loss_sha256, formatted_chars FROM a
"""

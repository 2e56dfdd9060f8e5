"""Chat formatting of reply trees, in DataFrame and SQL functions only.

Turns are nodes with a parent. Self-joins find every node's ancestor 2^k steps up and its depth (pointer doubling, so a tree
of depth d takes log2 d joins); the path of each leaf is then unrolled from the same tables, halving its segments until each is
one node. Leaves are ranked within their conversation by the sum of the scores on their path; each of the `best` paths
becomes one text.

Template: `<s>[INST] role LF text [/INST]</s>` a turn. In roles and texts `\\`, `<` and `[` become `\\s`, `\\l` and `\\b` (and
a line feed in a role `\\e`), so no control string can occur in them, and reading back is exact. The loss mask is an array
of (start, length) in characters over the texts of the roles trained on.

Defined cases: null texts and roles are empty; a null conversation is one conversation. Turns that tie are ordered by
role and text, and repeated rows of turns are turns of their own. In a tree, rows that repeat a node are one node: of its parents,
roles, texts and scores the first in that order counts (a null parent comes first). A row without a node is left out. An unknown
parent makes a root. A cycle of parents is cut above its smallest node, which becomes a root. Extra columns are dropped,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

OPEN, CLOSE = "<s>[INST] ", " [/INST]</s>"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\e"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def chains(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Flat turns as nodes: each turn replies to the one before it in its conversation."""
    w = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_last(), "role", "text")
    at = turns.select(F.col(conv).alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(w).cast("long").alias("node"))
    return at.withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)})


def _key():
    """Null conversations get a key of their own, so that joins see them."""
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))


def _cut(base: DataFrame, active: DataFrame, rounds: int) -> DataFrame:
    """base (c, node, up) with the cycles cut that the nodes of `active` lie on or lead into."""
    steps = written(base.join(active.select("c", "node"), ["c", "node"], "left_semi").select("c", "node", "up", F.col("node").alias("low")))
    for _ in range(rounds):  # `low`: the smallest of the nodes from here to 2^k - 1 steps above
        above = steps.select("c", F.col("node").alias("up"), F.col("up").alias("next"), F.col("low").alias("lower"))
        further = written(steps.join(above, ["c", "up"]).select("c", "node", F.col("next").alias("up"), F.least("low", "lower").alias("low")))
        dropped(steps)
        steps = further
    on = steps.select("c", F.col("up").alias("node")).distinct()  # so many steps above lies a node of the cycle, and all of those do
    heads = steps.join(on, ["c", "node"]).where("node = low").select("c", "node", F.lit(True).alias("head"))
    return written(base.join(heads, ["c", "node"], "left").select("c", "node", F.when(F.col("head"), F.lit(None)).otherwise(F.col("up")).alias("up")))


def paths(nodes: DataFrame) -> DataFrame:
    """(c, leaf, node, at): the nodes of each root-to-leaf path, `at` counting from 1 at the root; c names the conversation.

    nodes: conv_id, node, parent (null for a root), each node once. A parent that isn't there makes a root, a cycle is cut.
    """
    base = nodes.select(_key().alias("c"), "node", "parent")
    known = base.select("c", F.col("node").alias("parent"), F.lit(True).alias("there"))
    base = written(base.join(known, ["c", "parent"], "left").select("c", "node", F.when(F.col("there"), F.col("parent")).alias("up")))
    most = base.groupBy("c").count().agg(F.max("count")).first()[0] or 1
    rounds = most.bit_length()
    out, active = _paths(base, rounds)
    return out if active is None else _paths(_cut(base, active, rounds), rounds)[0]


def _paths(base: DataFrame, rounds: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(the paths, None), or (None, nodes that reach no root in so many rounds: those on a cycle or below one)."""
    # levels[k]: `up` is the ancestor 2^k steps above, `depth` the nodes from it down to here. A node whose root is reached
    # has no `up`, a final depth, and takes no part in later joins.
    levels = [base.select("c", "node", "up", F.when(F.col("up").isNull(), 1).otherwise(2).cast("long").alias("depth"))]
    final = levels[0].where("up is null")
    active = levels[0].where("up is not null")
    while not active.isEmpty():
        if len(levels) > rounds:
            return None, active
        above = active.unionByName(final).select("c", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        far = written(active.join(above, ["c", "up"]).select("c", "node", F.col("next").alias("up"), (F.col("depth") - 1 + F.col("more")).alias("depth")))
        levels.append(far)
        active = far.where("up is not null")
        final = final.unionByName(far.where("up is null"))
    parents = base.where("up is not null").select("c", F.col("up").alias("node")).distinct()
    leaves = final.join(parents, ["c", "node"], "left_anti")
    # a segment ends at `node`, holds `n` nodes upwards, and its last node has place `at`
    part = leaves.select("c", F.col("node").alias("leaf"), "node", F.col("depth").alias("n"), F.col("depth").alias("at"))
    for k in range(len(levels) - 2, -1, -1):
        half = 1 << k
        long = part.where(F.col("n") > half).join(levels[k].where("up is not null").select("c", "node", "up"), ["c", "node"])
        lower = long.select("c", "leaf", "node", F.lit(half).cast("long").alias("n"), "at")
        upper = long.select("c", "leaf", F.col("up").alias("node"), (F.col("n") - half).alias("n"), (F.col("at") - half).alias("at"))
        part = written(part.where(F.col("n") <= half).unionByName(lower).unionByName(upper))
    for level in levels[1:]:
        dropped(level)
    return part.select("c", "leaf", "node", "at"), None


def _unique(nodes: DataFrame) -> DataFrame:
    """Each node of a conversation once."""
    first = F.min(F.struct("parent", "role", "text", "score")).alias("x")
    return nodes.where("node IS NOT NULL").groupBy("conv_id", "node").agg(first).select("conv_id", "node", "x.*")


def formatted(nodes: DataFrame, best: int | None = 1, train_on: tuple[str, ...] = ("assistant",), unique: bool = False) -> DataFrame:
    """conv_id, leaf, place (1 is the best), score, n_turns, text and loss_mask of the chosen paths.

    nodes: conv_id, node, parent, role, text, score. `best`: paths kept for each conversation; None keeps all. `unique`: says
    that no node is repeated.
    """
    nodes = nodes if unique else written(_unique(nodes))
    rows = nodes.select(_key().alias("c"), "conv_id", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    steps = paths(nodes)
    scored = steps.join(rows.select("c", "node", "score"), ["c", "node"])
    ranks = scored.groupBy("c", "leaf").agg(F.sum("score").alias("score")).withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score"), "leaf")))
    chosen = ranks if best is None else ranks.where(F.col("place") <= best)
    line = steps.join(chosen, ["c", "leaf"]).join(rows.drop("score"), ["c", "node"])
    head = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\e")), F.lit("\n"))
    body = escaped(F.col("text"))
    line = line.select("c", "leaf", "conv_id", "place", "score", "at", F.concat(head, body, F.lit(CLOSE)).alias("piece"), F.length(head).alias("lead"), F.length(body).alias("size"), F.col("role").isin(*train_on).alias("loss"))
    past = Window.partitionBy("c", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(past), F.lit(0)) + F.col("lead"))
    grouped = line.groupBy("c", "leaf", "conv_id", "place", "score").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("at", "piece", "start", "size", "loss"))).alias("p"))
    mask = F.transform(F.filter("p", lambda x: x["loss"]), lambda x: F.struct(x["start"].cast("int").alias("start"), x["size"].cast("int").alias("length")))
    return grouped.select("conv_id", "leaf", "place", "score", "n_turns", F.concat_ws("", F.transform("p", lambda x: x["piece"])).alias("text"), mask.alias("loss_mask"))


def read_back(text: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation."""
    pieces = F.filter(F.split(text, "</s>", -1), lambda x: x != "")

    def turn(x):
        inner = F.substring(x, F.lit(len(OPEN) + 1), F.length(x) - len(OPEN) - (len(CLOSE) - 4))
        role = F.substring_index(inner, "\n", 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(inner, F.length(role) + 2, F.length(inner))).alias("text"))

    return F.transform(pieces, turn)


def chat_digests(turns: DataFrame) -> DataFrame:
    """Digests, read back from the formatted text, of all conversations and of conversation -1, which holds control strings."""
    spark = turns.sparkSession
    kind = dict(turns.dtypes)
    odd = spark.range(2).select(F.lit(-1).cast(kind["conv_id"]).alias("conv_id"), F.col("id").cast(kind["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = formatted(chains(turns.select("conv_id", "turn", "role", "text").unionByName(odd)), unique=True)
    back = out.select("conv_id", "text", "loss_mask", read_back(F.col("text")).alias("turns"))
    said = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform("loss_mask", lambda x: unescaped(F.substring(F.col("text"), x["start"] + 1, x["length"]))))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"))


_ESC = r"replace(replace(replace({0}, '\', '\s'), '<', '\l'), '[', '\b')"

#: Digests straight from the table; formatted_chars follows from the template.
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum({len(OPEN) + 1 + len(CLOSE)} + length(replace({_ESC.format('role')}, chr(10), '\\e')) + length({_ESC.format('text')})) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""

r"""Chat formatting of reply trees.

Messages name their parents. Self-joins enumerate the root-to-leaf paths:
pointer doubling first gives each message its 2^k-th ancestors, then each leaf
is split into ever shorter segments until every message of its path is known,
so a path of n messages costs log2(n) joins. Branches of a tree are ranked by
the mean score of their messages (ties: the smaller leaf id); the chosen ones
are formatted one conversation each.

Template, for each turn: ``### role: text </turn>\n``. Inside roles and texts a
backslash, ``###``, ``</turn>`` (and ``:`` in roles) get a backslash before
them, so ``parse`` reads back exactly what was formatted.

Defined results: a null text or role is empty, a null score is 0; rows with the
same turn are ordered by role, then text; rows with a null conv_id form one
conversation; a null turn comes first; an empty table gives an empty result.
Messages whose parents are missing are roots; cycles have no root and give no
path.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .cluster import cut

#: The conversation that the query adds to the table.
EXTRA = r"\### Assistant: </turn> ok"
#: The role whose texts are under the loss mask.
LEARNED = "assistant"
#: Deepest path, as a power of two.
MAX_DOUBLINGS = 30

_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\ ]++|\\.|(?! </turn>\n) )*+) </turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: Column, role: bool = False) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("###"), F.lit("\\###"))
    text = F.replace(text, F.lit("</turn>"), F.lit("\\</turn>"))
    return F.replace(text, F.lit(":"), F.lit("\\:")) if role else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append(tuple(_ESCAPED.sub(r"\1", x) for x in m.groups()))
        at = m.end()
    return turns


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node): every message of every root-to-leaf path.

    ``messages`` has tree, node and parent (null for a root); node is unique.
    """
    nodes = messages.select("tree", "node", "parent")
    alive = nodes.select(F.col("node").alias("parent"))
    hop = cut(nodes.join(alive, "parent", "left_semi").select("node", F.col("parent").alias("up")))
    leaves = nodes.join(hop.select(F.col("up").alias("node")), "node", "left_anti")
    hops = []
    while len(hops) < MAX_DOUBLINGS and not hop.isEmpty():
        hops.append(hop)
        far = hop.select(F.col("node").alias("up"), F.col("up").alias("far"))
        hop = cut(hop.join(far, "up").select("node", F.col("far").alias("up")))
    held = leaves.select("tree", F.col("node").alias("leaf"), "node")
    for hop in reversed(hops):
        held = held.unionByName(held.join(hop, "node").select("tree", "leaf", F.col("up").alias("node")))
        held = cut(held)
    return held


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """One conversation per chosen path: tree, leaf, rank, formatted.

    ``messages``: tree, node, parent, place (order in the path), role, text, score.
    ``branches``: how many of the best-scored paths of a tree; None keeps all.
    """
    texts = messages.select(
        "node", "place", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.concat(F.lit("### "), escape(F.coalesce("role", F.lit("")), True), F.lit(": "), escape(F.coalesce("text", F.lit(""))), F.lit(" </turn>\n")).alias("turn"),
    )
    whole = (
        paths(messages)
        .join(texts, "node")
        .groupBy("tree", "leaf")
        .agg(F.avg("score").alias("score"), F.sort_array(F.collect_list(F.struct("place", "turn"))).alias("turns"))
    )
    ranked = whole.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
    return ranked.select("tree", "leaf", "rank", "score", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"))


def linear(conversations: DataFrame) -> DataFrame:
    """Messages of a table (conv_id, turn, role, text): each turn answers the one before."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = conversations.select("conv_id", "role", "text", F.row_number().over(w).alias("place"))
    tree = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
    node = lambda place: F.concat(tree, F.lit("/"), F.format_string("%012d", place))
    return placed.select(
        "conv_id", tree.alias("tree"), node(F.col("place")).alias("node"), F.when(F.col("place") > 1, node(F.col("place") - 1)).alias("parent"),
        "place", "role", "text", F.lit(0.0).alias("score"),
    )


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    for b in batches:
        rows = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for tree, text in zip(b.column("tree").to_pylist(), b.column("formatted").to_pylist(), strict=True):
            turns = parse(text)
            loss = "".join(t for r, t in turns if r == LEARNED)
            for k, v in zip(rows, (None if tree == "null" else tree[1:], len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)), strict=True):
                rows[k].append(v)
        kinds = {"conv_id": pa.string(), "turns_sha256": pa.string(), "loss_sha256": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()], names=list(rows))


def digests(conversations: DataFrame) -> DataFrame:
    """The figures of every conversation of a table (conv_id, turn, role, text), read back from its formatted form."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    done = format_trees(linear(conversations.select("conv_id", "turn", "role", "text"))).select("tree", "formatted")
    read = done.mapInArrow(_read_back, "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return read.withColumn("conv_id", F.col("conv_id").cast(kind))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every conversation, and conversation -7."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA), (-7, 1, LEARNED, EXTRA)], "conv_id bigint, turn bigint, role string, text string")
    return digests(table.unionByName(extra))


#: The same rows in DuckDB.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length('### ' || replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') || ': ' ||
         replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') || ' </turn>' || chr(10)) AS n FROM c),
g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(n)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

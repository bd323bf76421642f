"""Reply trees formatted as conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Fixed values of the template; a text that holds one of the control strings gets a backslash after its first character.
OPEN, TURN, END, CLOSE = "<s>", "<|turn|>", "<|end|>", "</s>"
CONTROL = (TURN, END, OPEN, CLOSE, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


def escape(text: Column) -> Column:
    """Reversible: backslashes double, then each control string is broken by one backslash."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


class ReplyTrees:
    """Reply trees (tree, node, parent, role, text, score) and their branches, the paths from a root to a leaf.

    Iterative self-joins double each node's reach: a round's table has, for every node, the ancestor 1, 2, 4, ... steps
    up and the sum and number of the scores on the way there, so a tree of depth d takes log2(d) rounds of as many rows
    as there are nodes, and each leaf's whole branch is summed before any branch is written out. Only chosen branches
    become rows a step, by the same tables. Each round is a table in the shared folder.

    A root has a null parent or one that isn't in its tree. Rows that repeat a node of a tree are one node: the first
    by parent, score, role and text (unique says that there are none). Null trees or nodes, and nodes that hang on a
    cycle, are in no branch. Null scores are 0, null roles and texts empty. Other columns are ignored, whatever their
    names; an empty table has no branches. A branch becomes one row with its whole text, however long that is.
    """

    def __init__(self, nodes: DataFrame, *, tree_col: str = "tree", node_col: str = "node", parent_col: str = "parent", score_col: str | None = None, role_col: str | None = "role", text_col: str | None = "text", unique: bool = False):
        given = lambda name, kind, empty: F.coalesce(F.col(name).cast(kind), F.lit(empty)) if name else F.lit(empty)
        rows = nodes.select(F.col(tree_col).alias("tree"), F.col(node_col).alias("node"), F.col(parent_col).alias("parent"), given(score_col, "double", 0.0).alias("s"), given(role_col, "string", "").alias("role"), given(text_col, "string", "").alias("text")).where("tree is not null and node is not null")
        if not unique:
            rows = rows.groupBy("tree", "node").agg(F.min(F.struct("parent", "s", "role", "text")).alias("x")).select("tree", "node", "x.*")
        self.scratch = Scratch(nodes.sparkSession, "trees")
        self.nodes = self.scratch.table("nodes", rows)
        self.rounds = self._rounds()

    @staticmethod
    def _as(table: DataFrame, *more: str) -> DataFrame:
        return table.select(F.col("tree").alias("t"), F.col("node").alias("n"), *[F.col(c).alias(f"_{c}") for c in more])

    def _rounds(self) -> list[DataFrame]:
        here = (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("n"))
        first = self.nodes.select("tree", "node", "parent", "s").join(self._as(self.nodes), here, "left")
        state = self.scratch.table("up0", first.select("tree", "node", F.col("n").alias("up"), F.col("s").alias("sum"), F.lit(1).cast("long").alias("depth")))
        rounds, largest = [state], None
        while not state.where("up is not null").isEmpty():
            if len(rounds) > 6:  # what still has an ancestor farther up than its tree has nodes hangs on a cycle
                largest = largest or self.nodes.groupBy("tree").count().agg(F.max("count")).first()[0]
                if 1 << (len(rounds) - 1) > largest:
                    break
            far = self._as(state, "up", "sum", "depth")
            joined = state.where("up is not null").join(far, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("n")))
            farther = joined.select("tree", "node", F.col("_up").alias("up"), (F.col("sum") + F.col("_sum")).alias("sum"), (F.col("depth") + F.col("_depth")).alias("depth"))
            state = self.scratch.table(f"up{len(rounds)}", farther.unionByName(state.where("up is null")))
            rounds.append(state)
        return rounds

    def branches(self) -> DataFrame:
        """Every branch by its leaf: (tree, leaf, score, depth), the score being the mean of its nodes' scores."""
        parents = self.rounds[0].where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
        leaves = self.rounds[-1].where("up is null").join(parents, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
        return leaves.select("tree", F.col("node").alias("leaf"), (F.col("sum") / F.col("depth")).alias("score"), "depth")

    def best(self, per_tree: int = 1) -> DataFrame:
        """The per_tree best branches of each tree by score, ties to the longer and then to the smaller leaf: (tree, leaf, score, depth, rank)."""
        order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "leaf")  # Spark cuts to per_tree rows before the shuffle
        return self.branches().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_tree)

    def steps(self, chosen: DataFrame) -> DataFrame:
        """The nodes of chosen branches (tree, leaf, rank), a row a step: (tree, leaf, rank, node, distance), distance counted from the leaf."""
        steps = chosen.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("distance"))
        for k, table in enumerate(self.rounds[:-1]):
            steps = self.scratch.table(f"steps{k}", steps)
            up = self._as(table.where("up is not null"), "up")
            steps = steps.unionByName(steps.join(up, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", "rank", F.col("_up").alias("node"), (F.col("distance") + (1 << k)).alias("distance")))
        out = self.scratch.table("steps", steps)
        self.scratch.drop(*[n for n in self.scratch.paths if n.startswith("steps") and n != "steps"])
        return out

    def formatted(self, chosen: DataFrame, trained_role: str = "assistant") -> DataFrame:
        """Each chosen branch as one conversation: (tree, leaf, rank, formatted, loss_spans).

        loss_spans are (start, length) in code points of formatted: the texts of trained_role.
        """
        said = self._as(self.nodes, "role", "text")
        turns = self.steps(chosen).join(said, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", "rank", (-F.col("distance")).alias("pos"), F.concat(F.lit(TURN), F.url_encode("_role"), F.lit("\n")).alias("head"), escape(F.col("_text")).alias("body"), (F.col("_role") == trained_role).alias("trained"))
        held = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("pos", "head", "body", "trained"))).alias("turns"))
        text = F.concat(F.lit(OPEN), F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(END))), ""), F.lit(CLOSE))
        start = F.struct(F.lit(len(OPEN)).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

        def step(a, t):
            begin, size = a.at + F.length(t.head), F.length(t.body).cast("long")
            span = F.struct(begin.alias("start"), size.alias("length"))
            return F.struct((begin + size + len(END)).alias("at"), F.when(t.trained, F.array_append(a.spans, span)).otherwise(a.spans).alias("spans"))

        return held.select("tree", "leaf", "rank", text.alias("formatted"), F.aggregate("turns", start, step).getField("spans").alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Parses a formatted conversation back into an array of (role, text)."""
    inner = F.substring(formatted, F.lit(len(OPEN) + 1), F.length(formatted) - len(OPEN) - len(CLOSE))
    parts = F.filter(F.split(inner, r"<\|turn\|>", -1), lambda p, i: i > 0)

    def turn(p):
        head = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(head) + 2, F.length(p) - F.length(head) - 1 - len(END))
        return F.struct(F.url_decode(head).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), s.length.cast("int")))), "")


def conversation_nodes(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as trees of one branch: (tree, node, parent, role, text); rows by turn, ties by role and text.

    tree is a struct that holds the id, so rows of a null id are one conversation like others. Each row is a reply to
    the one before it; rows that repeat stay.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.struct(F.col(id_col).alias("id")).alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    node = F.row_number().over(order)
    return rows.select("tree", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text")

"""Chat formatting with budgeted windows, in DataFrame expressions only.

A conversation becomes one or more windows of whole turns.  Prefix sums of the turns' token
counts choose the spans: a window takes turns while the sum since its first turn stays within
what the budget leaves beside the system turn and the repeated history.  Every window starts
with the conversation's system turn (when its first turn is one) and repeats the latest turns
before its span up to ``history`` tokens.  Only an assistant turn that is new in its window is
under the loss mask, so a repeated target is masked and each is learned once.

Template of a turn: ``<|role|>`` newline, text, ``<|end|>`` newline.  ``&``, ``<`` and ``[``
inside roles and texts become ``&amp;``, ``&lt;`` and ``&#91;``, so that no control string, of this
template or of common ones, can come from a text; :func:`unescape` reverses it exactly.

Defined cases: a null role or text is empty; a null ``turn`` sorts first, ties of ``turn`` by
role, then text; repeated rows stay as turns of their own; a null ``conv_id`` is a conversation;
a turn longer than the budget has a window to itself and is never cut; an empty table gives no rows.
Tokens are estimated as a quarter of the code points, rounded up, plus ``TURN_TOKENS``.
other columns are not looked at.  A conversation is gathered as one row because its digest is of the whole of it;
the work grows in proportion to its turns: prefix sums are a window function, a window takes a slice of the turns, and
looks back no further than ``history`` can reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BUDGET, HISTORY, TURN_TOKENS = 1024, 128, 4
STARTS = 512  # windows whose starts are gathered at a time
EXTRA = "(-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<"))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row a window: ``conv_id, window, formatted, spans``.

    ``spans`` has, for each turn in the window: its place ``turn_index`` in the conversation,
    where its escaped ``role`` and text lie in ``formatted`` (code points from 0), whether it is
    ``repeated``, and whether its text is under the ``loss`` mask.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    cost = F.ceil(F.length("text") / F.lit(4)).cast("long") + F.lit(TURN_TOKENS)
    so_far = F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    turns = turns.select("conv_id", F.struct((F.row_number().over(order) - 1).alias("i"), so_far.alias("upto"), cost.alias("cost"), "role", "text").alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.withColumn("system", F.when(F.col("turns")[0]["role"] == "system", 1).otherwise(0))
    whole = whole.withColumn("room", F.greatest(F.lit(1), F.lit(budget - history) - F.when(F.col("system") == 1, F.col("turns")[0]["cost"]).otherwise(0)))
    # The next window starts at the first turn whose end lies beyond the room.  Starts are gathered a few hundred at a time.
    empty = F.array().cast("array<int>")
    room = lambda acc, t: (t["i"] > 0) & (t["upto"] - acc["since"] > acc["room"])
    full = lambda acc: F.size(acc["recent"]) >= STARTS
    starts = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("since"), F.col("room").cast("long").alias("room"), F.array(F.lit(0)).alias("recent"), F.array().cast("array<array<int>>").alias("older")),
        lambda acc, t: F.when(
            room(acc, t),
            F.struct(
                (t["upto"] - t["cost"]).alias("since"),
                acc["room"].alias("room"),
                F.concat(F.when(full(acc), empty).otherwise(acc["recent"]), F.array(t["i"])).alias("recent"),
                F.when(full(acc), F.concat(acc["older"], F.array(acc["recent"]))).otherwise(acc["older"]).alias("older"),
            ),
        ).otherwise(acc),
        lambda acc: F.concat(F.flatten(acc["older"]), acc["recent"]),
    )
    whole = whole.select("conv_id", "turns", "system", starts.alias("starts"))
    before = lambda i: F.get("turns", i)["upto"] - F.get("turns", i)["cost"]
    # A turn takes TURN_TOKENS at least, so only so many turns can be repeated.
    back = lambda first: F.element_at(
        F.filter(F.sequence(F.greatest(F.lit(0), first - F.lit(history // TURN_TOKENS)), first), lambda i: (before(first) - before(i) <= history) | (i == first)), 1
    )
    spanned = F.transform(
        "starts",
        lambda first, w: F.struct(
            w.alias("window"),
            first.alias("first"),
            F.greatest(back(first), F.least(F.col("system"), first)).alias("from"),
            F.coalesce(F.get("starts", w + 1), F.size("turns")).alias("after"),
        ),
    )
    whole = whole.select("conv_id", "turns", "system", spanned.alias("spanned"))
    taken = F.transform(
        "spanned",
        lambda s: F.struct(
            s["window"].alias("window"),
            s["first"].alias("first"),
            F.concat(
                F.when((F.col("system") == 1) & (s["from"] > 0), F.slice("turns", F.lit(1), F.lit(1))).otherwise(F.slice("turns", F.lit(1), F.lit(0))),
                F.slice("turns", s["from"] + 1, s["after"] - s["from"]),
            ).alias("turns"),
        ),
    )
    # An outer explode: the other kind would have all of the above once more in a filter.
    each = whole.select("conv_id", F.explode_outer(taken).alias("own")).select("conv_id", "own.*")
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            t["i"].alias("turn_index"),
            escape(t["role"]).alias("role"),
            escape(t["text"]).alias("text"),
            (t["i"] < F.col("first")).alias("repeated"),
            ((t["i"] >= F.col("first")) & (t["role"] == "assistant")).alias("loss"),
        ),
    )
    each = each.select("conv_id", "window", parts.alias("parts"))
    frame = len("<||>\n<|end|>\n")
    ends = F.aggregate(
        "parts",
        F.array(F.lit(0)),
        lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p["role"]) + F.length(p["text"]) + frame)),
    )
    each = each.withColumn("at", ends)
    turn_text = lambda p: F.concat(F.lit("<|"), p["role"], F.lit("|>\n"), p["text"], F.lit("<|end|>\n"))
    return each.select(
        "conv_id",
        "window",
        F.array_join(F.transform("parts", turn_text), "").alias("formatted"),
        F.transform(
            "parts",
            lambda p, i: F.struct(
                p["turn_index"].alias("turn_index"),
                (F.get("at", i) + 2).alias("role_start"),
                F.length(p["role"]).alias("role_length"),
                (F.get("at", i) + F.length(p["role"]) + 5).alias("text_start"),
                F.length(p["text"]).alias("text_length"),
                p["repeated"].alias("repeated"),
                p["loss"].alias("loss"),
            ),
        ).alias("spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: its turns' digest and that of the loss mask."""
    cut = lambda s, what: unescape(F.substring(F.col("formatted"), s[f"{what}_start"] + 1, s[f"{what}_length"]))
    new = F.transform(
        F.filter("spans", lambda s: ~s["repeated"]),
        lambda s: F.struct(
            s["turn_index"].alias("turn_index"), cut(s, "role").alias("role"), cut(s, "text").alias("text"), s["loss"].alias("loss")
        ),
    )
    per_window = formatted.select("conv_id", F.length("formatted").cast("long").alias("chars"), new.alias("new"))
    whole = per_window.groupBy("conv_id").agg(
        F.sort_array(F.flatten(F.collect_list("new"))).alias("turns"), F.sum("chars").alias("formatted_chars")
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_extra(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts are control strings of a common template."""
    more = conversations.sparkSession.sql(f"SELECT * FROM VALUES {EXTRA} AS t(conv_id, turn, role, text)")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(windows(with_extra(table(spark, sf_dir, "conversations"))))


#: The digests alone follow from the table; the formatted length follows from the windows, which SQL
#: states again here: the greedy spans as a recursion over turns, then the shown turns' lengths.
OP5_SQL = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    ceil(length(text) / 4.0)::BIGINT + {TURN_TOKENS} AS cost,
    length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
    + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + 13 AS chars
  FROM src WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY i) - cost AS before FROM t
), conv AS (
  SELECT conv_id, max(n) AS n, max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) AS sys,
    greatest(1, {BUDGET - HISTORY} - max(CASE WHEN i = 0 AND role = 'system' THEN cost ELSE 0 END)) AS room,
    max(CASE WHEN i = 0 THEN chars ELSE 0 END) AS first_chars
  FROM p GROUP BY conv_id
), win AS (
  SELECT conv_id, 0::BIGINT AS first FROM conv
  UNION ALL
  SELECT w.conv_id, x.i FROM win w JOIN conv c ON c.conv_id = w.conv_id
    JOIN p a ON a.conv_id = w.conv_id AND a.i = w.first
    JOIN p x ON x.conv_id = w.conv_id AND x.i > w.first AND x.before + x.cost - a.before > c.room
      AND (x.i = w.first + 1 OR x.before - a.before <= c.room)
), spans AS (
  SELECT *, coalesce(lead(first) OVER (PARTITION BY conv_id ORDER BY first), -1) AS after FROM win
), sized AS (
  SELECT s.conv_id, s.first, sum(CASE
      WHEN x.i >= s.first AND (s.after < 0 OR x.i < s.after) THEN x.chars
      WHEN x.i < s.first AND ((x.i = 0 AND c.sys = 1) OR a.before - x.before <= {HISTORY}) THEN x.chars
      ELSE 0 END) AS chars
  FROM spans s JOIN conv c ON c.conv_id = s.conv_id JOIN p a ON a.conv_id = s.conv_id AND a.i = s.first
    JOIN p x ON x.conv_id = s.conv_id GROUP BY ALL
), total AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM sized GROUP BY conv_id)
SELECT p.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  any_value(formatted_chars) AS formatted_chars
FROM p JOIN total USING (conv_id) GROUP BY p.conv_id
"""

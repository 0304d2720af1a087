"""Operator 7: chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the prompt, and its reply,
with the closing marker, is the only part to be trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def _piece(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def _safe(text: Column) -> Column:
    """Markers inside a text are broken up, so that no turn can pass for two."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def _safe_role(role: Column) -> Column:
    """A role in one line without markers: line breaks in it become blanks."""
    return F.translate(_safe(F.coalesce(role, F.lit("unknown"))), "\n\r", "  ")


def expand(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """(conv_id, turn, n_context, prompt, target, train_from, train_to), one row for each turn of the trained role.

    prompt ends with the header of the reply; target is the reply and its closing marker, and
    [train_from, train_to) is its range of characters in prompt followed by target. Turns are in the
    order of turn, equal ones by role and text, those without a number last. Rows equal in conv_id,
    turn, role and text count once. A null conv_id belongs to no conversation and is left out; a null
    role is "unknown"; a null text is empty. Markers in texts and roles are broken up, and a role's line breaks
    become blanks, so that neither can forge a turn. A reply without turns before it has its header alone as
    prompt. Long conversations are kept whole. Other columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    if START in trained_role or "\n" in trained_role or "\r" in trained_role:
        raise ValueError("trained_role must be one line without markers")
    turn = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), _safe_role(F.col("role")).alias("role"), _safe(F.col("text")).alias("text"))
    convs = turns.where(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t"))
    convs = convs.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    convs = convs.select("conv_id", F.transform("ts", lambda t: _piece(t["role"], t["text"])).alias("pieces"), F.posexplode("ts").alias("n_context", "t"))
    ours = convs.where(F.col("t.role") == trained_role)
    prompt = F.concat(F.array_join(F.slice("pieces", F.lit(1), F.col("n_context")), ""), F.lit(f"{START}{trained_role}\n"))
    made = ours.select("conv_id", F.col("t.turn").alias("turn"), F.col("n_context").cast("bigint").alias("n_context"), prompt.alias("prompt"), F.concat("t.text", F.lit(END)).alias("target"))
    start = F.char_length("prompt").cast("bigint")
    return made.select("*", start.alias("train_from"), (start + F.char_length("target")).alias("train_to"))


SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, translate(replace(coalesce(role, 'unknown'), '<|im_', '<| im_'), chr(10) || chr(13), '  ') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT *, row_number() OVER w - 1 AS n_context,
         coalesce(string_agg('{START}' || role || chr(10) || text || '{END}' || chr(10), '')
                  OVER (PARTITION BY conv_id ORDER BY turn IS NULL, turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')
         || '{START}{TRAINED_ROLE}' || chr(10) AS prompt
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn IS NULL, turn, role, text)
)
SELECT conv_id, turn, CAST(n_context AS BIGINT) AS n_context, prompt, text || '{END}' AS target,
       CAST(length(prompt) AS BIGINT) AS train_from, CAST(length(prompt) + length(text) + {len(END)} AS BIGINT) AS train_to
FROM p WHERE role = '{TRAINED_ROLE}'
"""

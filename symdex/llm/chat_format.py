"""Operator 10: chat formatting by a finite-state machine over roles, in DataFrame and SQL functions only.

A template declares the marks of a turn, the control strings that a text may not hold as such, the allowed role
transitions and the roles whose text is trained on. A conversation's turns, in order, become segments of text with
a loss flag; joined, they are the formatted conversation. Inside roles and texts each control string gets an escape
character after its first character (one more, if it has some already), which is undone exactly when it is read back.

Rows are grouped by conversation, which is one training example and one digest, and so is one row. Turns are
sorted by turn, then role, then text, nulls first; repeated rows are repeated turns. Null text and null role count
as empty; a null conversation id is a conversation of its own; an empty table gives no rows. A conversation that
the machine refuses is formatted all the same, with `valid` false. Further columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.llm.shared import table


@dataclass(frozen=True)
class Template:
    turn: str = "<|turn|>"
    body: str = "<|text|>"
    end: str = "<|end|>"
    after: str = "\n"
    escape: str = "\\"
    #: All control strings, the marks among them; each begins with < or [ and ends with > or ], so no two overlap.
    controls: tuple[str, ...] = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> state
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    accepting: tuple[str, ...] = ("assistant",)


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in s)


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _controls(t: Template) -> tuple[str, str, str]:
    """Patterns of a first character, of the escapes and of what follows them."""
    heads = "".join("\\" + c for c in sorted({c[0] for c in t.controls}))
    return f"([{heads}])", f"({_quoted(t.escape)}*)", "(" + "|".join(_quoted(c[1:]) for c in t.controls) + ")"


def escaped(t: Template, column: str) -> str:
    head, some, rest = _controls(t)
    return f"regexp_replace({column}, {_sql(head + some + rest)}, {_sql('$1$2' + _quoted(t.escape) + '$3')})"


def unescaped(t: Template, column: str) -> str:
    head, some, rest = _controls(t)
    return f"regexp_replace({column}, {_sql(head + some + _quoted(t.escape) + rest)}, '$1$2$3')"


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): the sorted turns of each conversation."""
    row = F.struct(df[turn].alias("turn"), F.coalesce(df[role], F.lit("")).alias("role"), F.coalesce(df[text], F.lit("")).alias("text"))
    return df.select(df[conv].alias(conv), row.alias("t")).groupBy(conv).agg(F.sort_array(F.collect_list("t")).alias("turns"))


def segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds `valid` and `segments` (text, loss) to (conv, turns)."""
    t = template
    steps = ", ".join(f"{_sql(f'{a}>{r}')}, {_sql(b)}" for a, x in t.transitions.items() for r, b in x.items())
    state = f"aggregate(turns, 'start', (s, t) -> coalesce(try_element_at(map({steps}), concat(s, '>', t.role)), 'refused'))"
    loss = "t.role IN (" + ", ".join(map(_sql, t.loss_roles)) + ")"
    own = f"struct(concat({_sql(t.turn)}, {escaped(t, 't.role')}, {_sql(t.body)}) AS text, false AS loss), struct({escaped(t, 't.text')} AS text, {loss} AS loss), struct({_sql(t.end + t.after)} AS text, false AS loss)"
    return turns.withColumn("valid", F.expr(f"{state} IN ({', '.join(map(_sql, t.accepting))})")).withColumn("segments", F.expr(f"flatten(transform(turns, t -> array({own})))"))


def formatted(segmented: DataFrame) -> DataFrame:
    """Adds `formatted`, the segments joined."""
    return segmented.withColumn("formatted", F.expr("array_join(transform(segments, s -> s.text), '')"))


def read_back(df: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds `parsed` (role, text of each turn) and `loss_text`, from `formatted` and `segments` alone."""
    t = template
    tail = len(t.end + t.after)
    cut = f"filter(split(formatted, {_sql(_quoted(t.turn))}, -1), (c, i) -> i > 0)"
    parts = f"transform({cut}, c -> split(c, {_sql(_quoted(t.body))}, 2))"
    turn = f"struct({unescaped(t, 'p[0]')} AS role, {unescaped(t, f'left(p[1], char_length(p[1]) - {tail})')} AS text)"
    lost = f"array_join(transform(filter(segments, s -> s.loss), s -> {unescaped(t, 's.text')}), '')"
    return df.withColumn("parsed", F.expr(f"transform({parts}, p -> {turn})")).withColumn("loss_text", F.expr(lost))


def digests(df: DataFrame, conv: str = "conv_id", template: Template = Template()) -> DataFrame:
    out = read_back(formatted(segments(turns_of(df, conv), template)), template)
    said = F.expr(r"array_join(transform(parsed, p -> concat(p.role, '\n', p.text, '\n')), '')")
    return out.select(
        conv, F.size("parsed").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"), "valid",
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT -7L AS conv_id, x.turn, x.role, '</s>[INST] ok [/INST]' AS text FROM (SELECT explode(array(struct(0L AS turn, 'user' AS role), struct(1L AS turn, 'assistant' AS role))) AS x)")
    return digests(rows.unionByName(own))


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS next,
  length(regexp_replace(role, '([<\[])(\\*)(\|turn\|>|\|text\|>|\|end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(\|turn\|>|\|text\|>|\|end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(n + 24) AS BIGINT) AS formatted_chars,
bool_and(CASE role WHEN 'system' THEN before IS NULL AND next IS NOT NULL WHEN 'user' THEN coalesce(before, 'system') IN ('system', 'assistant') AND next IS NOT NULL WHEN 'assistant' THEN coalesce(before, '') = 'user' ELSE false END) AS valid
FROM e GROUP BY conv_id
"""

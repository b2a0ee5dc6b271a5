"""Issue and patch pairs for a sequence model: truncation to a shared budget, and token lists.

The tokenizer is a pair of SQL builders, encode(text) -> array and
decode(array) -> text; the default takes runs without white space, as no
subword vocabulary belongs to the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diff import prioritized, split_lines

#: Tokens of a pair, of which the model's own marks take three; the issue's least share; characters reckoned for a token.
MAX_LENGTH, MARKS, LEAST_ISSUE, MOST_ISSUE, TOKEN_CHARS = 256, 3, 16, 48, 4


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^\\\\s]+', 0)"


def joined(tokens: str) -> str:
    return f"array_join({tokens}, ' ')"


def truncate(pairs: DataFrame, max_length: int = MAX_LENGTH, encode: Callable[[str], str] = words, decode: Callable[[str], str] = joined) -> DataFrame:
    """pairs (.., problem_statement, patch) with both texts cut to the budget.

    Pairs that fit stay as they are.  Else the patch may use what the issue's
    least share leaves: it is pruned line by line (context first, then lines
    that exceed the characters reckoned for its tokens), and only then cut at a
    token.  The issue gets what is left.
    """
    budget = max_length - MARKS
    if budget <= 0:
        return pairs
    rest = [c for c in pairs.columns if c not in ("problem_statement", "patch")]
    rows = pairs.select(*rest, F.coalesce("problem_statement", F.lit("")).alias("_i"), F.coalesce("patch", F.lit("")).alias("_p"))
    rows = rows.withColumn("_ti", F.expr(encode("_i"))).withColumn("_n", F.expr(f"size({encode('_p')})"))
    rows = rows.withColumn("_over", F.expr(f"size(_ti) + _n > {budget}"))
    rows = rows.withColumn("_room", F.expr(f"{budget} - least(size(_ti), greatest({LEAST_ISSUE}, least({MOST_ISSUE}, {budget} div 4)))"))
    rows = rows.withColumn("_1", F.expr(f"case when _over and _n > _room then (case when _p = '' then _p else array_join({split_lines('_p')}, '\\n') end) else _p end"))
    rows = rows.withColumn("_2", F.expr(f"case when _over and _n > _room and size({encode('_1')}) > _room then {prioritized('_1', f'_room * {TOKEN_CHARS}')} else _1 end"))
    rows = rows.withColumn("_t2", F.expr(f"case when _over then {encode('_2')} end"))
    rows = rows.withColumn("_3", F.expr(f"case when _over and _n > _room and size(_t2) > _room then {decode('slice(_t2, 1, _room)')} else _2 end"))
    rows = rows.withColumn("_left", F.expr(f"greatest(0, {budget} - least(size(_t2), case when _n > _room then _room else size(_t2) end))"))
    issue = f"case when _over and size(_ti) > _left then {decode('slice(_ti, 1, _left)')} else _i end"
    return rows.select(*rest, F.expr(issue).alias("problem_statement"), F.col("_3").alias("patch"))


def tokens(pairs: DataFrame, max_length: int = MAX_LENGTH, encode: Callable[[str], str] = words, decode: Callable[[str], str] = joined) -> DataFrame:
    """pairs with `tokens`, those of the truncated issue and patch in turn, at most the budget, and not padded."""
    rest = [c for c in pairs.columns if c not in ("problem_statement", "patch")]
    cut = truncate(pairs, max_length, encode, decode)
    return cut.select(*rest, F.expr(f"slice(concat({encode('problem_statement')}, {encode('patch')}), 1, {max(max_length - MARKS, 0)})").alias("tokens"))

"""Column functions over text that both the rules and the queries use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions.constants import BLOCK, CODE, LINK, NUMBER, PARENS, QUOTES, TOKEN, URL

OPEN, CLOSE = "\x01", "\x02"
MATCH = "struct<start:int,text:string>"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, however many expressions read them.

    A generator of one row stands between: the optimiser would otherwise put
    the expression in each reader's place.
    """
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select("*", F.explode(F.array(made)).alias("__once")).select(*(c for c in df.columns if c not in columns), "__once.*")


def rounded(x: Column, digits: int) -> Column:
    """A double of 0 or more, rounded by its exact binary value; only an exact tie goes to the even digit.

    0.35 lies below its decimal and becomes 0.3, 2.25 is a tie and becomes
    2.2. The fraction is taken as 63 bits of integer arithmetic.
    """
    whole = F.floor(x)
    high = F.floor((x - whole) * 2.0**31)
    low = F.floor(((x - whole) * 2.0**31 - high) * 2.0**32)
    wide = lambda c: c.cast("decimal(20,0)")
    bits = (wide(high) * F.lit(2**32).cast("decimal(10,0)") + wide(low)).cast("decimal(20,0)")
    parts = (bits * F.lit(2 * 10**digits).cast("decimal(6,0)")).cast("decimal(28,0)")  # twice the digits, in 2 ** -63
    last = F.floor(parts / F.lit(str(2**64)).cast("decimal(20,0)")).cast("long")
    over = parts - (2 * last + 1).cast("decimal(8,0)") * F.lit(str(2**63)).cast("decimal(19,0)")
    up = (over > 0) | ((over == 0) & (last % 2 == 1))
    return (whole * 10**digits + last + up.cast("long")).cast("double") / float(10**digits)


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_extract(c, r"(?Us)^\s*+(.*\S)", 1)


def blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def marked(c: Column, pattern: Column | str) -> Column:
    """The text cut before each match; each piece but the first is a match, CLOSE, and what follows it."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.split(F.regexp_replace(F.translate(c, OPEN + CLOSE, ""), F.concat(F.lit("("), pattern, F.lit(")")), F.lit(f"{OPEN}$1{CLOSE}")), OPEN)


def match_all(c: Column, pattern: Column | str) -> Column:
    """Every match as (start, text), offsets from 0: an array for each row, made in one pass over its pieces."""
    parts = marked(c, pattern)
    first = F.struct(F.length(F.element_at(parts, 1)).alias("at"), F.expr(f"cast(array() as array<{MATCH}>)").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        hit = F.substring_index(part, CLOSE, 1)
        return F.struct((acc["at"] + F.length(part) - 1).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), hit.alias("text")))).alias("out"))

    return F.when(F.size(parts) > 1, F.aggregate(F.slice(parts, 2, F.size(parts)), first, step, lambda acc: acc["out"])).otherwise(F.expr(f"cast(array() as array<{MATCH}>)"))


def mask(c: Column, pattern: str) -> Column:
    """Matches replaced by as many blanks."""
    parts = marked(c, pattern)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.repeat(F.lit(" "), F.length(F.substring_index(p, CLOSE, 1))), F.substring(p, F.length(F.substring_index(p, CLOSE, 1)) + 2, F.length(p))))), "")


def unquoted(c: Column) -> Column:
    """What stands in parentheses or straight quotes becomes as many blanks."""
    return F.when(c.contains("(") | c.contains('"'), mask(mask(c, PARENS), QUOTES)).otherwise(c)


def tokens_of(c: Column) -> Column:
    """Words as (start, text); what stands in parentheses or straight quotes has none."""
    return match_all(unquoted(c), TOKEN)


def words_of(c: Column) -> Column:
    """The words of ``tokens_of`` without their places."""
    return F.regexp_extract_all(unquoted(c), F.lit(TOKEN), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(unquoted(c), F.lit(TOKEN))


def controlled_words(c: Column) -> Column:
    """The number of words where a parenthesis, a quotation, and a number with what follows it count as one each."""
    one = F.lit(" ONEWORD ")
    marks = c.contains("(") | c.contains('"')
    t = F.when(marks, F.regexp_replace(F.regexp_replace(c, F.lit(PARENS), one), F.lit(QUOTES), one)).otherwise(c)
    t = F.when(t.rlike(r"(?U)\d"), F.regexp_replace(t, F.lit(NUMBER), one)).otherwise(t)
    return F.regexp_count(t, F.lit(TOKEN))


def inline_clean(c: Column) -> Column:
    """Without inline code and addresses; links leave their labels. Lines without a sign of any are left as they are."""
    some = c.contains("`") | c.contains("](") | c.contains("http") | c.contains("www.")
    return F.when(some, F.regexp_replace(F.regexp_replace(F.regexp_replace(c, CODE, " "), LINK, "$1"), URL, " ")).otherwise(c)


def hide_block(c: Column) -> Column:
    """A heading or item mark becomes as many blanks."""
    head = F.regexp_extract(c, f"({BLOCK})", 1)
    return F.concat(F.repeat(F.lit(" "), F.length(head)), F.substring(c, F.length(head) + 1, F.length(c)))


def trim_edge(c: Column) -> Column:
    return F.regexp_replace(c, "^['’-]+|['’-]+$", "")

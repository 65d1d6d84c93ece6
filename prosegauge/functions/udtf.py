"""A table function for SQL users: ``SELECT d.doc_id, t.* FROM docs d, LATERAL controlled_tokens(d.text) t``.

Plans of this package use ``functions.text.tokens_of``, which stays in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from prosegauge.functions.constants import PARENS, QUOTES, TOKEN


class Tokens:
    """The words of a text with their places from 0; parentheses and straight quotes have none."""

    def eval(self, text: str):
        plain = text or ""
        for hidden in (PARENS, QUOTES):
            plain = re.sub(hidden, lambda m: " " * len(m.group()), plain)
        for i, m in enumerate(re.finditer(TOKEN, plain)):
            yield i, m.start(), m.group()


def register(spark: SparkSession, name: str = "controlled_tokens") -> None:
    spark.udtf.register(name, udtf(Tokens, returnType="idx int, start int, word string"))

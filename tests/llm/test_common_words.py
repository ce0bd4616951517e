"""The list of common words is taken whole or refused."""

import pytest

from lattiq.llm import quality


def test_long_list_is_refused(spark):
    words = spark.range(100_001).selectExpr("concat('w', id) as word")
    with pytest.raises(ValueError, match="common words"):
        quality._hashes(words)
    assert len(quality._hashes(words.where("word <> 'w7'"))[1]) == 100_000

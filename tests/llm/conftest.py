import random

import pytest

SYLLABLES = "an be ce do en fi ga he in jo ka le mo ni or pa qu re so ti un ve wi xa yo ze".split()


class Maker:
    """Texts of made-up words, the same for the same seed."""

    def __init__(self, seed):
        self.rng = random.Random(seed)
        self.lexicon = ["".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 4))) for _ in range(400)]

    def words(self, n):
        return self.rng.choices(self.lexicon, k=n)

    def text(self, n, line=12):
        words = self.words(n)
        return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))


@pytest.fixture
def maker():
    return Maker(11)


@pytest.fixture
def docs_of(spark):
    """A table of documents with columns whose names the operators use themselves."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long, key long, words string, n_lines long, gone string, start long"):
        return spark.createDataFrame([(i, t, *(list(rest) + [None] * 8)[:8]) for i, t, *rest in rows], schema)

    return make

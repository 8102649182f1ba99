import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session", autouse=True)
def scratch_folder(spark, tmp_path_factory):
    """Tests have no cluster to name the shared folder."""
    from tiller.llm.common import ship

    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    ship(spark)


class Corpus:
    """Documents with copies, near copies, shared lines and passages, and odd rows."""

    def __init__(self):
        import random

        rnd = random.Random(3)
        words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "té", "ßo") for b in
                 ("ra", "sen", "tor", "vi", "x")]

        def prose(n):
            return " ".join(rnd.choice(words) for _ in range(n))

        line = "This line stands in many a document of the corpus."
        passage = prose(90)
        self.rows = []
        base = prose(120)
        for i in range(60):
            text = prose(rnd.randint(3, 160))
            if i % 7 == 0:
                text = base
            elif i % 7 == 1:
                own = base.split(" ")
                own[rnd.randrange(120)] = "changed"
                text = " ".join(own)
            if i % 5 == 0:
                text += f"\n  {line.upper() if i % 2 else line} \n" + prose(5)
            if i % 6 == 2:
                text += " " + passage + " " + prose(3)
            self.rows.append((i, text, "en" if i % 3 else "fr", f"src{i % 4}"))
        self.rows += [(100, None, None, None), (101, "", "en", "src1"), (102, " \n\t ", None, "src1"),
                      (103, "One TWO", "en", None), (104, "one two", "en", "src0"),
                      (105, passage + " " + prose(9000) + " " + passage, "en", "src2"),
                      (3, self.rows[3][1], "en", "src3"), (None, passage, "en", "src1"),
                      (106, "x" * 3000, "de", "src1"), (107, "İ Σ <|endoftext|> \x01a", "en", "src1")]
        self.passage = passage

    def frame(self, spark):
        """With columns whose names the operators use inside."""
        extra = "id long, row long, key string, class long, size string, spans string, words int"
        clash = (1, 2, "k", None, "s", None, 5)
        return spark.createDataFrame(
            [(*r, *clash) for r in self.rows],
            "doc_id long, text string, lang string, source string, " + extra).repartition(3)

    def empty(self, spark):
        return self.frame(spark).limit(0)


@pytest.fixture(scope="session")
def corpus():
    return Corpus()

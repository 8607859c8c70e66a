import random

import pytest

#: A column of every awkward kind: nulls, empty and long texts, repeated rows, ties, clashing names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, _key long, fp string, score string, held_out string, h long, node long, n long"
WORDS = {
    "en": "the of and ing tion er th in on an re ed ha to it is that was for with".split(),
    "de": "der die und ein ung keit lich sch ver zu von mit auf nicht heit pf tz au ge be".split(),
    "fr": "le la de des que qui eau eux ment tion par une est dans elle oi ou re pa vi".split(),
}


def prose(rng, lang="en", words=60, line=12):
    stems = WORDS[lang]
    made = ["".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(words)]
    return "\n".join(" ".join(made[i : i + line]) for i in range(0, len(made), line))


@pytest.fixture(scope="session")
def awkward():
    rng = random.Random(11)
    base = [prose(rng, lang, rng.randint(30, 120)) for lang in ("en", "de", "fr") for _ in range(8)]
    texts = [*base, None, "", "   \n\t ", "!!! 123 ...", "x", base[0], base[0], base[1] + " tail", prose(rng, "en", 20_000), "word " * 3000, "\n".join(base[2].split("\n") + base[3].split("\n")), "ÉCOLE ünder   nbsp \x1c sep"]
    rows = []
    for i, t in enumerate(texts):
        lang = None if i % 7 == 3 else ("en", "de", "fr")[min(i // 8, 2)]
        rows.append((i * 3 + 1, t, lang, None if i % 5 == 0 else f"s{i % 4}", None if t is None else len(t), i, i, "f", "s", "h", i, i, i))
    rows.append(rows[0])  # a repeated row
    rows.append((None, base[4], "de", "s1", 5, 0, 0, None, None, None, 0, 0, 0))
    rows.append((None, None, None, None, None, None, None, None, None, None, None, None, None))
    rows.append((rows[5][0], "another text of the same id", "en", "s0", 3, 0, 0, "", "", "", 0, 0, 0))
    return rows


@pytest.fixture
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def as_table(tmp_path):
    """Write frames as the tables of a folder, for registered queries."""

    def write(**frames):
        for name, df in frames.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write

"""Values of any length are replaced whole, in time that grows with the text, under a key that no plan shows."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quernstone.llm import pii

from . import mirror

JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
#: Text with a place for a value, the value, and its kind.
WHOLE = [
    ("password={} and", "Ab1x" * 50, "secret"), ("token={}", JWT, "secret"), ("is {} .", "0aF3" * 32, "secret"), ("to {}@example.com.", "x" * 69 + "1", "email"),
    ('{{"password": "{}"}}', "hunter22xyz", "secret"), ("von {}@example.com", "josé.garcía", "email"), ("{{'api_key':'{}'}}", "Zm9vYmFy1w==", "secret"), ("secret: {}.", "pä55wört~ß", "secret"), ("a {}@" + "sub." * 12 + "example.com", "n.n", "email"),
]


@pytest.mark.parametrize("name", range(len(WHOLE)))
def test_no_part_of_a_value_stays(spark, name):
    shape, value, kind = WHOLE[name]
    got = pii.pseudonymise(spark.createDataFrame([(shape.format(value),)], "text string"), "k", counts=True).first()
    assert got.pii_counts == {kind: 1}, got
    before, after = shape.format("\0").split("\0")
    assert got.text.startswith(before) and got.text.endswith(after)
    new = got.text[len(before) : len(got.text) - len(after)]
    assert len(new) == len(value) and not any(new[i : i + 8] == value[i : i + 8] for i in range(len(value) - 7) if value[i : i + 8].isalnum())
    hexadecimal = bool(re.fullmatch("[0-9A-Fa-f]{16,}", value))
    assert (hexadecimal or [c.isdigit() for c in new] == [c.isdigit() for c in value]) and all(a == b for a, b in zip(new, value) if not b.isalnum())
    assert not value.isascii() or new == mirror.text(value, "k", kind, hexadecimal)


def test_other_letters_stay_apart(spark):
    """Distinct texts get distinct pseudonyms, beyond ASCII too."""
    rows = [(f"{a}{b}x{c}",) for a in "éèàüßøж漢" for b in "aéЖ" for c in "ñ1z"]
    got = spark.createDataFrame(rows, "t string").select(pii.feistel_text(F.col("t"), F.lit("k"), "email").alias("x")).collect()
    assert len({r.x for r in got}) == len(rows) and all(len(r.x) == 4 for r in got)


def test_long_runs_of_numbers(spark):
    rnd = random.Random(1)
    seconds = []
    for n in (100, 100_000):
        df = spark.createDataFrame([(" ".join(str(rnd.randrange(1000, 9999)) for _ in range(n)),)], "text string")
        start = time.perf_counter()
        got = pii.pseudonymise(df, "k", counts=True).first()
        seconds.append(time.perf_counter() - start)
    assert len(got.text) == 500_000 - 1 and got.pii_counts["card"] > 1000
    assert seconds[1] - seconds[0] < 30


def scanned(run):
    """The places of cards in a run, in plain Python."""
    tokens = re.findall("[ -]?[0-9]+", run)
    text = lambda i, j: re.sub("^[ -]", "", "".join(tokens[i : i + j]))
    luhn = lambda d: sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(int(c) for c in reversed(d))) % 10 == 0
    valid = lambda t: 13 <= len(mirror.digits(t)) <= 19 and luhn(mirror.digits(t))
    if valid(run) and mirror.digits(run).strip("0"):
        return [(0, len(tokens))]
    every = [(not re.match(pii.REGULAR, text(i, j)), i, -j) for i in range(len(tokens)) for j in range(1, min(19, len(tokens) - i) + 1) if valid(text(i, j)) and re.match(pii.ISSUED, text(i, j))]
    taken = []
    for odd, i, j in sorted(every):
        if (not odd or i == 0 or i - j == len(tokens)) and all(i - j <= a or b + a <= i for a, b in taken):
            taken.append((i, -j))
    return sorted(taken)


def test_cards_of_runs_against_all_windows(spark):
    rnd = random.Random(7)
    cards = ["4111 1111 1111 1111", "4111111111111111", "3782 822463 10005", "5500 0000 0000 0004", "6011-0009-9013-9424"]
    runs = []
    for _ in range(150):
        parts = [rnd.choice(cards) if rnd.random() < 0.4 else str(rnd.randrange(10 ** rnd.randrange(1, 8))) for _ in range(rnd.randrange(1, 7))]
        runs.append(re.sub(" $", "", "".join(p + " " for p in parts)))
    runs = [r for r in runs if len(mirror.digits(r)) >= 13 and "-" not in r.replace("6011-0009-9013-9424", "")]
    got = spark.createDataFrame(list(enumerate(runs)), "i int, t string").select("i", pii._cards(F.col("t"), F.lit("k")).alias("c")).collect()
    for r in got:
        run = runs[r.i]
        places, tokens = scanned(run), re.findall("[ -]?[0-9]+", run)
        assert (r.c.n or 0) == len(places), (run, places, r)
        if places:
            want, end = "", 0
            for i, j in places:
                whole = "".join(tokens[i : i + j])
                lead = re.match("[ -]?", whole).group()
                want += "".join(tokens[end:i]) + lead + mirror.card(whole[len(lead) :], "k")
                end = i + j
            assert r.c.value == want + "".join(tokens[end:]), (run, places)


def test_the_key_is_in_no_plan(spark, capsys):
    df = pii.pseudonymise(spark.createDataFrame([(1, "a@example.com")], "id int, text string"), "open sesame")
    df.explain("extended")
    assert "open sesame" not in capsys.readouterr().out and "open sesame" not in df._jdf.queryExecution().toString()
    assert re.search("(?i)secret|password|token|access[.]?key", pii.KEY)


def test_columns_that_clash(spark):
    df = spark.createDataFrame([("a@example.com", "old", 1, 2)], "text string, pii_counts string, _key int, _swaps int")
    got = pii.pseudonymise(df, "k", counts=True)
    assert got.columns == ["text", "_key", "_swaps", "pii_counts"] and got.first()[1:] == (1, 2, {"email": 1})
    assert pii.pseudonymise(df, "k").columns == df.columns and pii.pseudonymise(df.limit(0), "k").collect() == []

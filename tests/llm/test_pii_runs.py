"""Cards beside other numbers, and dates in timestamps."""

import re

from quernstone.llm import pii

from .test_learned import luhn

CARD, DASHED, PLAIN, OTHER, AMEX = "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "5500 0000 0000 0004", "3782 822463 10005"
#: Text with a place for cards, and the cards in it.
RUNS = [("card {} 12/27.", CARD), ("{} 123", PLAIN), ("no 5 {}", CARD), ("12345 {}", CARD), ("{} 12 27 999", DASHED), ("1 2 3 {} 4 5 6 7", AMEX), ("{} {}", CARD, OTHER), ("{} {} 77", CARD, PLAIN), ("{}/12", CARD), ("{}, {}", CARD, DASHED), ("8 {} 9999 0", CARD)]
DATES = ["2024-01-05T10:00:00Z", "2024-01-05T10:00", "20 2024-01-05T1000 x", "2024-01-05T10Z", "at 2024-01-05T23:59:59.123+02:00"]
BESIDE = [f"{CARD} 2024-01-05", f"{CARD} 555-123-4567", f"{PLAIN} 05/12/2024", f"{CARD} 10.0.0.1"]
LEFT = ["1234 5678 9012 3456 78", "2024-01-05Tx", "2024-01-05x", "1 2 3 4 5 6 7 8 9 10 11 12 13"]


def test_cards_in_runs(spark):
    rows = [(i, t.format(*c)) for i, (t, *c) in enumerate(RUNS)] + [(100 + i, t) for i, t in enumerate(DATES)] + [(200 + i, t) for i, t in enumerate(BESIDE)] + [(300 + i, t) for i, t in enumerate(LEFT)]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id int, text string"), "k", counts=True).collect()}
    for i, (t, *cards) in enumerate(RUNS):
        m = re.fullmatch(re.escape(t).replace(r"\{\}", "{}").format(*("(" + re.sub("[0-9]", "[0-9]", c) + ")" for c in cards)), got[i].text)
        assert m, (t, got[i].text)
        assert got[i].pii_counts == {"card": len(cards)}, (t, got[i])
        for new, card in zip(m.groups(), cards, strict=True):
            assert new != card and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", card) and luhn(re.sub(r"\D", "", new)), (t, got[i].text)
    for i, t in enumerate(DATES):
        at = t.index("2024")
        new = got[100 + i].text
        assert new[at : at + 10] != t[at : at + 10] and new[:at] + new[at + 10 :] == t[:at] + t[at + 10 :] and got[100 + i].pii_counts == {"iso_date": 1}
    for i, t in enumerate(BESIDE):
        assert sum(got[200 + i].pii_counts.values()) == 2 and not set(t.split()[-1:]) & set(got[200 + i].text.split()), got[200 + i]
    assert [got[300 + i].text for i in range(len(LEFT))] == LEFT

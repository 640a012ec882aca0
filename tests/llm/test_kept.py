"""The encoder's table of units holds the words that one worker's share of texts has."""

from textguard.llm import pieces


def test_half_a_million_units_are_made_once():
    made = []
    table = pieces.Kept(lambda key: made.append(key) or b"", pieces.KEPT_UNITS)
    for _ in range(2):
        for i in range(500_000):
            table[str(i)]
    assert len(made) == 500_000

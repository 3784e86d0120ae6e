"""Documents for the edge cases: nulls anywhere, empty and long texts, ties, repeated rows, foreign columns."""

WORDS = "the of and to in that for with on as by at from is was are be this have not but they you all can her one our out day".split()


def prose(n, start=0, step=7):
    return " ".join(WORDS[(start + i * step + i // 5) % len(WORDS)] for i in range(n))


def story(seed, n=120):
    """n words that differ for each seed."""
    return " ".join(f"{WORDS[(seed * 31 + i * i) % len(WORDS)]}{(seed * 7919 + i * 104729) % 997}" for i in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(*items):
    return [(i, t, lang, source, len(t) if t is not None else None) for i, t, lang, source in items]


EDGES = rows(
    (1, None, "en", "a"),
    (2, "", None, None),
    (3, " \n\t ", "en", "a"),
    (4, "1234 5678 -- !!", "en", "b"),
    (5, "word", "en", "a"),
    (None, story(5), "en", "a"),
    (7, story(7), "en", "c"),
    (7, story(7), "en", "c"),
    (8, story(8, 30_000), "en", "a"),
    (9, "ünï çødé " * 60 + "\U0001f600", "de", "b"),
    (10, story(7), "en", "b"),
)

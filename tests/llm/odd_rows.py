"""Odd rows that every operator must take."""

LONG = "word " * 30_000
TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa. Licensed under the Apache License, Version 2.0.", "a"),
    (2, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa. Licensed under the Apache License, Version 2.0.", "a"),
    (3, None, None),
    (4, "", "b"),
    (5, LONG, "b"),
    (5, LONG, "b"),
    (None, "one two three", "c"),
    (7, "one two three", "c"),
    (8, "MIT license, mit License; CC-BY and GNU General Public License", "c"),
    (9, "  \t\n ", "a"),
]
# names that operators use inside or return
CLASHES = "keep times rows copy __id __bytes __lid n head full c0 c1 comp cls list slot n_words found spans host path rule verdict score shard place media bytes i t h tie size row id".split()


def carried(out, but=()):
    """Every clashing column that is still there holds its own name in every row."""
    rows = out.collect()
    return all(r[c] == c for r in rows for c in CLASHES if c not in but) and len(rows)

"""Rows that every operator must bear."""

#: Null, empty, white space, ties, repeated rows, null ids, unusual characters.
ODD = [(0, None), (1, ""), (2, " \n\t"), (3, "a b"), (4, "ab"), (5, "ab"), (5, "ab"), (None, "ab"), (None, None), (6, "naïve 中文 😀 \x00 x"), (7, "A" * 5000), (8, "one")]

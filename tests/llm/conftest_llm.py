"""Texts for the small tests."""

#: Texts for the small tests: null, empty, blank, ties, odd characters.
ODD = [None, "", " ", "\n\n", "a", "a b", "ÀÉ É x", "x\x00y 😀 ﬁ", "<s> </s> ▁ ▁▁x", "tab\tand\r\nline \x0b \x1c sep"]


def prose(seed, n):
    """``n`` words from a small vocabulary, the same for the same seed."""
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(text, step, seed=0):
    """``text`` with every ``step``-th word replaced."""
    words = text.split(" ")
    return " ".join(f"z{seed}{i}" if i % step == step - 1 else w for i, w in enumerate(words))

"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = "the of and to in a is that it with as was for on are by this be from or one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, place string, kind string, blob string, near string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(99)) if rng.random() < 0.4 else "") for _ in range(n)).capitalize() + "."


def text(rng, n=8):
    return "\n".join(sentence(rng, rng.randrange(4, 20)) for _ in range(n))


def documents(seed=7, n=60):
    """Rows of SCHEMA; some columns carry names that operators use inside."""
    rng = random.Random(seed)
    texts = [text(rng, rng.randrange(1, 12)) for _ in range(n)]
    passage = sentence(rng, 60)
    for k in range(0, n, 7):
        texts[k] = texts[k] + "\n" + passage
    for k in range(1, n, 9):
        words = texts[(k + 3) % n].split(" ")
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = "changed"
        texts[k] = " ".join(words)
    texts[5] = texts[2]
    texts[6] = "Subscribe now\n" + texts[6]
    for k in range(10, 30, 2):
        texts[k] = "Subscribe now\n" + texts[k]
    texts[40] = None
    texts[41] = ""
    texts[42] = "   \n\n  \t "
    texts[43] = "!!! *** ???"
    texts[44] = "à la carte — ünïcödé 漢字テキスト 🙂 " * 9
    texts[45] = "one two"
    texts[46] = "a" * 400
    texts[47] = text(rng, 400)
    texts[48] = "x  y \n z\r\n\tq "
    texts[49] = "<|endoftext|> ends <|endoftext|>"
    rows = [(k, t, "en", f"src{k % 3}", len(t or ""), "s", "p", "k", "b", "n") for k, t in enumerate(texts)]
    rows.append((n, None, None, None, None, None, None, None, None, None))
    return rows


def odd_rows():
    """Repeated rows and ids, and null ids."""
    rng = random.Random(11)
    t = text(rng, 6)
    return [(1, t, "en", "a", 1, "", "", "", "", ""), (1, t, "en", "a", 1, "", "", "", "", ""), (1, t + " more", "en", None, 1, "", "", "", "", ""), (None, t, "en", "a", 1, "", "", "", "", ""), (None, None, None, None, None, None, None, None, None, None)]

"""A small corpus with the awkward cases, and brute-force versions to hold operators against."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, node int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus():
    """Rows with nulls in any column, empty, very short and very long texts, copies, edits and shared passages."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(60), [rng.choice(vocabulary) for _ in range(120)]
    texts = ["", None, "  \t ", "one", "One", "two words", "a\r\nb", "a \x0b\nb", "x y z", "naïve café ☃ 𝒳 end", "<|endoftext|> and <|startoftext|>", "  ́e"]
    texts += [prose(rng.randint(3, 200)) for _ in range(40)]
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    for _ in range(8):
        texts.append(f"{prose(20)}\n{passage}\n{prose(15)}")
    texts += [texts[20]] * 5 + [texts[20].replace(" ", "  "), texts[20].upper(), prose(6000), "again and again " * 300, "again " * 80]
    rows = [(i * 3 + 1, t, rng.choice(["en", None]), "s", len(t or ""), "k", 1) for i, t in enumerate(texts)]
    rows += [rows[30], rows[30], (None, texts[22], None, None, None, None, None), (None, "no id here", "en", "s", 3, "k", 2)]
    rng.shuffle(rows)
    return rows


def similar_lines(rows):
    """Texts without the lines that resemble an earlier line; rows are (doc_id, text) with distinct ids."""
    seen, out = [], {}
    for i, text in sorted(rows):
        kept = []
        for line in (text or "").split("\n"):
            w = set(words(lowered(line)))
            if not w or not any(7 * len(w & v) >= 3 * (len(w) + len(v)) for v in seen):
                kept.append(line)
            if w:
                seen.append(w)
        out[i] = "\n".join(kept)
    return out


def shingle_set(text):
    w = words(lowered(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    """Smallest id that links reach, by id; rows are (doc_id, text), ids may repeat."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            n = len(a & b)
            if (a or b) and 100 * n >= 75 * (len(a) + len(b) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def repeated_words(texts, width=35):
    """For each text, which of its words a repeated window covers."""
    from collections import Counter

    all_words = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in all_words for i in range(len(w) - width + 1))
    out = []
    for w in all_words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((w, gone))
    return out

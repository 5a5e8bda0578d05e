"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, copies, passages."""

import random

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people mr how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars) rows."""
    rng = random.Random(seed)
    passage = sentence(rng, 70)
    line = "all rights reserved under the license of this work by its maker"
    texts = []
    for i in range(n):
        body = [sentence(rng, rng.choice([8, 30, 60, 120])) for _ in range(rng.choice([1, 2, 3]))]
        if i % 5 == 0:
            body.insert(rng.randrange(len(body) + 1), passage)
        if i % 4 == 0:
            body.append(line)
        texts.append("\n".join(body))
    base = texts[3]
    for k in range(6):  # near copies of one text
        w = base.split(" ")
        w[(7 * k) % len(w)] = f"changed{k}"
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], texts[7].upper(), texts[0] + " and more"]
    texts += [None, "", "   \n\t ", "one", "one two three", "One TWO three", "word " * 400, "ab ab ab " * 60, "x" * 500, "é" * 130, "é" * 130 + " end", "\u0001odd\u0002 marks\u0003"]
    texts += [" ".join(["same"] * 70) + " tail " + passage, "lead " + " ".join(["same"] * 90)]
    long = "\n".join(sentence(rng, 200) for _ in range(20))
    texts += [long, long + "\n" + passage]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", "É", None]), None if i % 9 == 0 else len(t or "")))
    return rows


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

"""Plain versions of the operators for small tables, in single-threaded Python."""

import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_components(rows, width=3, percent=85):
    """{doc_id: (n_shingles, component_id)} from all pairs."""
    sets = {i: shingles(t, width) for i, t in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    for i in ids:
        common = {}
        for s in sets[i]:
            for j in where[s]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def substring(rows, span=50):
    """{doc_id: (n_words, n_removed, kept_sha256)}, for distinct ids."""
    return {i: r for (i, _), r in zip(rows, substring_rows(rows, span))}


def substring_rows(rows, span=50):
    """(n_words, n_removed, kept_sha256) of each row; rows without an id are no documents."""
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - span + 1 if i is not None else 0):
            window = tuple(w[k : k + span])
            first[window] = min(i, first.get(window, i))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - span + 1 if i is not None else 0):
            if first[tuple(w[k : k + span])] < i:
                gone.update(range(k, k + span))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def pack(tails, weight, window):
    """Sequences of (tail, from, to) by the plainest greedy packer: the seed takes the window, then the unused tails
    by their score for the seed (the sum of ``weight`` over the ids they share), ties and those without a score by place."""
    left, unused, out = {i: len(t) for i, t in enumerate(tails)}, list(range(len(tails))), []
    seed = unused[0] if unused else None
    while seed is not None:
        unused = [i for i in unused if i != seed]
        score = {i: sum(weight(t, i) for t in sorted(set(tails[seed]) & set(tails[i]))) for i in unused}
        sequence, room, carried = [], window, None
        for i in [seed, *sorted(unused, key=lambda i: (score[i] <= 0, -score[i], i))]:
            at, take = len(tails[i]) - left[i], min(room, left[i])
            sequence.append((i, at, at + take))
            left[i] -= take
            room -= take
            unused = [k for k in unused if k != i]
            if left[i]:
                carried = i
            if not room:
                break
        out.append(sequence)
        seed = carried if carried is not None else unused[0] if unused else None
    return out


def language_vector(text, slot_of, idf):
    """{slot: weight} of a text's letter n-grams, at unit length."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    letters = " " + " ".join(letters.split()) + " "
    if not letters.strip():
        return None
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            slot = slot_of(letters[i : i + n])
            counts[slot] = counts.get(slot, 0) + 1
    v = {s: math.log1p(c) * idf[s] for s, c in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {s: x / norm for s, x in v.items()}


def machine_score(x, w0, w, v):
    """A factorisation machine by its pairs: ``x`` is {feature: value}."""
    y = w0 + sum(w[i] * a for i, a in x.items())
    items = list(x.items())
    for k, (i, a) in enumerate(items):
        y += sum(sum(p * q for p, q in zip(v[i], v[j])) * a * b for j, b in items[:k])
    return 1 / (1 + math.exp(-y))

"""Plain versions of the operators, for small tables."""

from collections import defaultdict


def words(text):
    return (text or "").encode().split()


def grams(text, width=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def similar(a, b, percent=80):
    both = len(a & b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def jaccard_links(rows, percent=80):
    """For each row the other rows it is linked to."""
    sets = [grams(t) for _, t in rows]
    out = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j], percent):
                out[i].add(j)
                out[j].add(i)
    return out


def classes(n, links):
    """Smallest row number reachable from each row."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([label[i], *(label[j] for j in links[i])])
            if low < label[i]:
                label[i], changed = low, True
    return label


def late_lines(rows, percent=80, least=1):
    """(id, number) of lines that repeat an earlier one, in the order of id and number."""
    lines = [
        (i, k, grams(line))
        for i, text in sorted(rows)
        for k, line in enumerate((text or "").split("\n"))
        if len(words(line)) >= least
    ]
    return {
        (i, k)
        for n, (i, k, s) in enumerate(lines)
        if any(similar(s, t, percent) for _, _, t in lines[:n])
    }


def has_near(item, text, edits):
    """Whether some part of the text is within so many edits of the item (Sellers)."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best <= edits, best

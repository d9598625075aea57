"""Plain versions of the operators, for small inputs."""

import re

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def letters(text):
    return LETTERS.findall((text or "").translate(SMALL))


def shingles(text):
    words = NOT_BLANK.findall((text or "").translate(SMALL))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def groups_of(rows, percent=75):
    """Smallest id reachable, by id, over all pairs of (id, text)."""
    sets = [(key, shingles(text)) for key, text in rows if key is not None]
    root = {key: key for key, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, one) in enumerate(sets):
        for b, two in sets[:i]:
            small, large = sorted((len(one), len(two)))
            if not small or 100 * small < percent * large:
                continue
            both = len(one & two)
            if both and 100 * both >= percent * (len(one) + len(two) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {key: find(key) for key in root}


def contamination(rows, items, window=10):
    """(id, words, words hit, items) of each (id, text)."""
    windows = {}
    for item, text in items:
        words = letters(text)
        size = min(len(words), window)
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(-1 if item is None else item)
    sizes = {len(w) for w in windows}
    found = []
    for key, text in rows:
        words, hit, owners = letters(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                own = windows.get(tuple(words[i : i + size]))
                if own:
                    hit.update(range(i, i + size))
                    owners |= own
        found.append((key, len(words), len(hit), sorted(owners)))
    return found


def chunk_bounds(text, gear, gear_bytes, chunk_words, calm_words=12):
    """Byte ranges of the chunks of a text, rolling over one byte at a time."""
    data = text.encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    bounds, seen = [], []
    for number, (start, end) in enumerate(words):
        rolled = 0
        for byte in data[max(0, start - gear_bytes) : start]:
            rolled = (rolled * 2 + gear[byte]) % (1 << 32)
        seen.append(rolled & 0xFFFF)
        calm = number + 1 >= calm_words and seen[-1] == min(seen[-calm_words:])
        if number == 0 or seen[-1] < 0x10000 // chunk_words or calm:
            bounds.append([number, start, end])
        bounds[-1][2] = end
    return words, bounds


def repeated(rows, gear, gear_bytes=16, chunk_words=4, least_words=20):
    """(id, text, words, words cut) of each (id, text): later copies of chunks, in runs of enough words, are cut."""
    cut = {}
    first = {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            cut[key] = ([], [])
            continue
        words, bounds = chunk_bounds(text, gear, gear_bytes, chunk_words)
        marks = []
        for number, start, end in bounds:
            digest = text.encode()[start:end]
            marks.append(digest in first)
            first.setdefault(digest, key)
        cut[key] = (words, list(zip(bounds, marks, strict=True)))
    result = []
    for key, text in rows:
        words, chunks = cut[key]
        data, parts, at, removed, i = (text or "").encode(), [], 0, 0, 0
        while i < len(chunks):
            j = i
            while j < len(chunks) and chunks[j][1]:
                j += 1
            if j > i:
                after = chunks[j][0][0] if j < len(chunks) else len(words)
                n = after - chunks[i][0][0]
                if n >= least_words:
                    parts.append(data[at : chunks[i][0][1]])
                    at = chunks[j][0][1] if j < len(chunks) else len(data)
                    removed += n
            i = max(j, i + 1)
        parts.append(data[at:])
        result.append((key, None if text is None else b"".join(parts).decode(), len(words), removed))
    return result


def together(rows, gear, least_words=20):
    """(id, text, words, words cut): runs of chunks with enough words that stand in one earlier place are cut from later ones.

    Every place of a chunk is held against all earlier places of the same chunk.
    """
    texts = []
    for key, text in sorted(rows, key=lambda r: r[0]):
        words, bounds = chunk_bounds(text or "", gear, 16, 4)
        data = (text or "").encode()
        ends = [b[0] for b in bounds[1:]] + [len(words)]
        texts.append((key, text, data, words, [data[a:z] for _, a, z in bounds], [b[0] for b in bounds], ends))
    places, result = {}, []
    for n, (key, text, data, words, chunks, first, ends) in enumerate(texts):
        gone = set()
        for i, chunk in enumerate(chunks):
            for m, j in places.get(chunk, ()):
                earlier, k = texts[m][4], 1
                # A run that goes on further back was seen from there.
                if i and j and chunks[i - 1] == earlier[j - 1]:
                    continue
                while i + k < len(chunks) and j + k < len(earlier) and chunks[i + k] == earlier[j + k]:
                    k += 1
                if ends[i + k - 1] - first[i] >= least_words:
                    gone.update(range(first[i], ends[i + k - 1]))
            places.setdefault(chunk, []).append((n, i))
        kept, at = b"", 0
        for w in sorted(gone):
            kept += data[at : words[w][0]] if at < words[w][0] else b""
            at = words[w + 1][0] if w + 1 < len(words) else len(data)
        result.append((key, None if text is None else (kept + data[at:]).decode(), len(words), len(gone)))
    return result

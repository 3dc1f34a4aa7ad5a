"""Plain Python versions of the training-data operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words(text):
    return WORD.findall(text or "")


def targets(rows, share=Fraction(3, 2), weights=(5, 2, 1), most=2):
    """Target of each source by repeated capping, in fractions."""
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(words(text))
    ordered = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ordered)}
    total, done, open_ = share * sum(size.values()), {}, set(ordered)
    while open_:
        each = {s: (total - sum(done.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if each[s] > most * size[s]]
        if not over:
            return size, done | each
        done |= {s: Fraction(most * size[s]) for s in over}
        open_ -= set(over)
    return size, done


def token_rows(rows, encode):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encode(text or "") + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def bench_words(text):
    return BENCH_WORD.findall((text or "").translate(LOWER))


def contaminated(rows, items):
    windows = defaultdict(set)
    for item_id, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item_id)
    lengths, out = {len(w) for w in windows}, []
    for doc_id, text in rows:
        w, hit, found = bench_words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= ids
        found = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(found).encode()), bool(hit)))
    return out


SECRETS = [
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    re.compile("AKIA[A-Z0-9]+"),
    re.compile("[0-9a-f]+"),
]
KINDS = ("assign", "access", "hex")


def secrets(text):
    found = []
    for k, pattern in enumerate(SECRETS):
        for m in pattern.finditer(text or ""):
            if len(m[2] if k == 0 else m[0]) >= (6, 20, 24)[k]:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups(rows):
    """doc_id -> (size, component, kept); ids are unique here."""
    sets = {doc_id: shingles(text) for doc_id, text in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = sorted((find(a), find(b)))
                up[rb] = ra
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def without_repeats(rows, n=50):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; rows of an id are one document."""
    data = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in data:
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            if d is not None and (s not in first or d < first[s]):
                first[s] = d
    out = []
    for d, b in data:
        gone = bytearray(len(b) + 1)
        for i in range(len(b) - n + 1):
            if d is not None and first[b[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=False) if not g))))
    return out


def rule_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), len(lines)


def host_rules(rows):
    """(doc_id, five counts, base_failed, kept) of rows (doc_id, text, host)."""
    fails, own, base = defaultdict(list), [], []
    for _, text, host in rows:
        c = rule_counts(text)
        own.append(c)
        base.append(c[0] < 10 or 100 * c[4] > 20 * c[0])
        fails[host].append((c[0] < 10, 100 * c[4] > 20 * c[0], c[2] > 0.1 * c[1], c[3] > 0.3 * c[5]))
    bad = set()
    for k in range(4):
        n, fail = {h: len(x) for h, x in fails.items()}, {h: sum(f[k] for f in x) for h, x in fails.items()}
        total = sum(n.values())
        mean, strength = sum(fail.values()) / max(1, total), 1e4
        noise, spread = len(n) - 1, total - sum(x * x for x in n.values()) / max(1, total)
        if 0 < mean < 1 and spread > noise:
            seen = sum(n[h] * (fail[h] / n[h] - mean) ** 2 for h in n) / (mean * (1 - mean))
            rho = (seen - noise) / (spread - noise)
            strength = 1e4 if rho <= 1 / (1 + 1e4) else max(1.0, 1 / rho - 1)
        for h in n:
            a, b = fail[h] + mean * strength, n[h] - fail[h] + (1 - mean) * strength
            if a / (a + b) - 2 * (a * b / (a + b) ** 2 / (a + b + 1)) ** 0.5 > max(0.3, mean + 0.25):
                bad.add(h)
    return [(r[0], *c[:5], b, not b and r[2] not in bad) for r, c, b in zip(rows, own, base, strict=True)]


def word_pieces(text, begin, within):
    """(words, pieces, unknown) by greedy longest match of byte pieces; a word is read with a space before it."""
    n = total = unknown = 0
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]", (text or "").encode()):
        word, at, count, vocabulary = b" " + m[0], 0, 0, begin
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), at)
            if end == at:
                count = 0
                break
            at, count, vocabulary = end, count + 1, within
        n, total, unknown = n + 1, total + max(1, count), unknown + (count == 0)
    return n, total, unknown


def similar_groups(rows, size=3, least=90):
    """doc_id -> (set size, component); rows of an id are one document."""
    sets = defaultdict(set)
    for doc_id, text in rows:
        w = words((text or "").translate(LOWER))
        sets[doc_id].add(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)) if w))
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    each = sorted((d, s) for d, all_ in sets.items() for s in all_ if s)
    for i, (a, x) in enumerate(each):
        for b, y in each[i + 1 :]:
            if 100 * min(len(x), len(y)) >= least * max(len(x), len(y)) and 100 * len(x & y) >= least * len(x | y):
                ra, rb = sorted((find(a), find(b)))
                up[rb] = ra
    return {d: (max(map(len, all_)), find(d)) for d, all_ in sets.items()}


def trie(rows):
    """Nodes of rows (conv_id, turn, role, text): (conv_id, depth, parent, members, children, leaves, saved, ends)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h, base = zlib.crc32(str(c).encode()) % 6, int(abs(c) - abs(c) % 100) * (1 if c >= 0 else -1)
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    return [(m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], sha(",".join(map(str, ends.get(k, []))).encode())) for k, m in members.items()]


def divergence(rows, least=3, scale=10**9, top=200):
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for (lang, source), own in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        sides = {s: c for (g, s), c in counts.items() if g == lang}

        def p(c, kept=kept):
            n = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + scale * (c[t] + 1) // n for t in kept}

        mine, f = p(own), lambda a, b: (a - b) ** 2 // b
        whole = p(sum(sides.values(), Counter()))
        parts = {"pair": [(s, sum(f(mine[t], q[t]) for t in kept)) for s, c in sides.items() if s != source for q in [p(c)]], "term": [(t, f(mine[t], whole[t])) for t in kept if own[t] and mine[t] > whole[t]]}
        for part, items in parts.items():
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < top]
    return out

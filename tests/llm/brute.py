"""Plain, slow versions of the operators, for comparison on small tables."""

import hashlib
import re

ASCII_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def low(text):
    return (text or "").translate(ASCII_UPPER)


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def contamination(docs, items, span=10):
    """{(doc_id, text): (n_words, n_hit, n_items, sha, contaminated)}"""
    cut = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    windows = {}
    for item, text in items:
        w = cut(text)
        for s in range(max(1, len(w) - span + 1)) if w else ():
            windows.setdefault(tuple(w[s : s + span]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w = cut(text)
        hit, found = set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[s : s + size]))) is not None:
                    hit.update(range(s, s + size))
                    found |= own
        out[doc, text] = (len(w), len(hit), len(found), sha(sorted(map(str, found))), bool(hit))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {p + j for own in places.values() if len(own) > 1 for p in own for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed)


def fits(rule_host, rule_path, host, path):
    return (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path)


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return low(host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def maximal_chats(log):
    """{conv: [(role, text)]} of conversations that are no prefix of another; log: (conv, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in log:
        convs.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    lists = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[0], x[1] or 0))] for c, v in convs.items()}
    rank = lambda c: (c is None, c or 0)
    return {
        c: own for c, own in lists.items()
        if not any((len(other) > len(own) and other[: len(own)] == own) or (other == own and rank(d) < rank(c)) for d, other in lists.items())
    }


def base_secrets(text):
    text, out = text or "", []
    patterns = (
        ("assign", r"""(?a:(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)))""", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    )
    for i, (kind, pattern, good) in enumerate(patterns):
        out += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if good(m)]
    out.sort()
    return (*(sum(x[1] == i for x in out) for i in range(3)), sha([x[2] for x in out]))


def shingles(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def similar_components(docs, width=4, percent=85):
    """[(doc_id, n, component)] in the order of ``docs``; all pairs with a shared shingle are tested."""
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    by_shingle = {}
    for i, s in enumerate(sets):
        partners = {}
        for g in s:
            for j in by_shingle.setdefault(g, []):
                partners[j] = partners.get(j, 0) + 1
            by_shingle[g].append(i)
        for j, both in partners.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[top(i)] = top(j)
    smallest = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            smallest[top(i)] = min(d, smallest.get(top(i), d))
    return [(d, len(sets[i]), smallest.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)]


def luhn(digits):
    own = [int(d) for d in reversed(digits)]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def base_pii(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    patterns = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    for i, (kind, pattern, good) in enumerate(patterns):
        out += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if good(m)]
    out.sort()
    return (*(sum(x[1] == i for x in out) for i in range(4)), sha([x[2] for x in out]))

"""Other ways to what queries return, written for clarity and nothing else."""

import datetime
import hashlib
import hmac
import math
import re
from collections import Counter


def quality_verdict(text, lang, model, base, languages, bands, script, guess):
    """(tokens, characters per token, byte share, entropy share, kept) from the pieces as strings."""
    n_words, n_repeat = base
    failed = n_words < 20 or 100 * n_repeat > 30 * n_words
    pieces = model.encode(text, out_type=str)
    n = len(pieces)
    if not n:
        return 0, None, None, None, False
    counts = Counter(pieces)
    entropy = sum(-c / n * math.log2(c / n) for c in counts.values()) / math.log2(max(2, min(n, model.vocab_size())))
    per_token, fallback = len(text) / n, sum(c for p, c in counts.items() if re.fullmatch("<0x[0-9A-F]{2}>", p)) / n
    wide = bands[script]
    kept = wide.chars_per_token[0] <= per_token <= wide.chars_per_token[1] and fallback <= wide.byte_share and entropy >= wide.entropy_share
    own = languages.get((lang or "").lower().replace("_", "-").split("-")[0])
    if kept and own:
        size = min(max(n, own.tokens[0]), own.tokens[1])
        inside = per_token >= own.chars_per_token - own.chars_slack / math.sqrt(size) and fallback <= own.byte_share and entropy >= own.entropy_share + own.entropy_slope * math.log2(size / 1024)
        kept = inside or guess(text) not in (lang, None)
    return n, per_token, fallback, entropy, kept and not failed


def secret_spans(text, count_tokens, known, path):
    """(base spans, all spans) as strings; candidates are found character by character."""
    base = []
    at = 0
    while m := re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A).search(text, at):
        if len(m[2]) >= 6:
            base.append((m.start(), 0, m.end()))
        at = m.end()
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        base += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]

    def runs(a, b, more):
        start = a
        for i in range(a, b + 1):
            if i == b or not (text[i].isascii() and (text[i].isalnum() or text[i] in more)):
                if i - start >= 20:
                    yield start, i
                start = i + 1

    free = lambda a, b: all(y <= a or b <= x for x, _, y in base)
    random = lambda a, b: not re.fullmatch(known, text[a:b]) and len(text[a:b]) < 2 * count_tokens(text[a:b])
    found = []
    for a, b in runs(0, len(text), "+/_=-"):
        if re.fullmatch(known, text[a:b]):
            continue
        if free(a, b) and not re.fullmatch(path, text[a:b]) and random(a, b):
            found.append((a, 3, b))
        else:
            found += [(x, 3, y) for x, y in runs(a, b, "+") if (x, y) != (a, b) and free(x, y) and random(x, y)]
    names = ("assign", "access", "hex", "random")
    spelled = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return spelled(base), spelled(base + found)


def permuted(value, high, low, key, label):
    a, b = divmod(value, low)
    for i in range(8):
        digest = lambda x: int(hmac.new(key.encode(), f"{label}|{i}|{x}".encode(), "sha256").hexdigest()[:15], 16)  # noqa: B023, E731
        if i % 2 == 0:
            a = (a + digest(b) % high) % high
        else:
            b = (b + digest(a) % low) % low
    return a * low + b


def refill(pattern, digits):
    digits = iter(digits)
    return "".join(next(digits) if c in "0123456789" else c for c in pattern)


def luhn(digits):
    """The sum over digits of which the first, third ... are doubled."""
    return sum(sum(divmod(int(d) * 2, 10)) if i % 2 == 0 else int(d) for i, d in enumerate(digits))


def pseudonym(x, key):
    digits = re.sub("[^0-9]", "", x)
    if "@" in x:
        return "u" + hmac.new(key.encode(), f"email|{x.lower()}".encode(), "sha256").hexdigest()[:12] + "@" + x.split("@")[1]
    if x.startswith("+1"):
        return refill(x, "1" + str(permuted(int(digits[1:]), 10**5, 10**5, key, "phone")).zfill(10))
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", x):
        start = datetime.date(1800, 1, 1)
        try:
            day = (datetime.date.fromisoformat(x) - start).days
        except ValueError:
            return x
        return str(start + datetime.timedelta(permuted(day, 189, 773, key, "date")))
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", x):
        areas = [a for a in range(1, 900) if a != 666]
        area, group, serial = map(int, x.split("-"))
        if area not in areas or not group or not serial:
            return x
        new = permuted((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
        return f"{areas[new // (99 * 9999)]:03}-{new // 9999 % 99 + 1:02}-{new % 9999 + 1:04}"
    if "." in x:
        octets = [int(o) for o in x.split(".")]
        if max(octets) > 255:
            return x
        return ".".join(map(str, permuted(int.from_bytes(bytes(octets)), 65536, 65536, key, "ip").to_bytes(4)))
    if luhn(digits) % 10:
        return x
    new = str(permuted(int(digits[:15]), 10**8, 10**7, key, "card")).zfill(15)
    return refill(x, new + str(-luhn(new) % 10))


def pseudonymised(text, key):
    """(text, values replaced)."""
    kinds = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"\+1 ?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])", r"(?<![0-9])(?:1[89]|20|21)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9])",
        r"(?<![0-9-])[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"(?<![0-9])[0-9]{4}(?P<gap>[ -]?)[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}(?![0-9])", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    ]
    changed = 0

    def one(m):
        nonlocal changed
        new = pseudonym(m[0], key)
        changed += new != m[0]
        return new

    out = re.sub("|".join(kinds), one, text)
    return out, changed

"""The main chain, the rule engine and the title ranking in plain Python, written from their description and not from the plans.
Only the fixed tables are shared."""

import math
import re
import statistics
from collections import Counter

from pagewright.plans import constants as C


def rows_of(blocks):
    """Blocks (dicts) of one document in order, with what most tests need."""
    out = []
    for b in sorted(blocks, key=lambda b: b["seq"]):
        t = b["text"].strip(" ")
        out.append({**b, "t": t, "low": t.lower(), "words": t.split()})
    return out


def python(pattern):
    """A pattern for this engine: classes of Unicode categories are spelled with str methods elsewhere, so only these occur."""
    return re.compile(pattern.replace(r"\p{Nd}", r"\d"), re.ASCII if r"\p" not in pattern else 0)


def noise(b):
    t, low = b["t"], b["low"]
    return len(t) < 2 or len(t) > 500 or any(python(p).search(t) for p in C.FORM) or any(python(p).search(low) for p in C.TOC + C.NOISE)


def language(t):
    low = t.lower()
    has = lambda chars: re.search(chars, t)
    if not t:
        return "unknown"
    if has("[぀-ゟ゠-ヿ]") or has("[一-龯]") and has(r"第\d+章|第\d+節"):
        return "japanese"
    if has("[一-鿿]") and has(r"第\d+章|第\d+节"):
        return "chinese"
    if has("[가-힯]"):
        return "korean"
    for name, letters, words in (("french", "[àâäçéèêëîïôöùûüÿ]", ("chapitre", "résumé")), ("german", "[äöüß]", ("kapitel", "zusammenfassung")), ("spanish", "[áéíóúüñ]", ("capítulo", "resumen"))):
        if has(letters) or any(w in low for w in words):
            return name
    return "english"


def unique(rows):
    seen, out = set(), []
    for b in rows:
        if not noise(b) and b["low"] not in seen:
            seen.add(b["low"])
            out.append(b)
    return out


def clean(t):
    return re.sub(r"\.+$", "", re.sub(r"\s+", " ", t).strip())


def scored(b, mean, top, lang):
    span = top - mean
    limits = [mean + span * k for k in (0.7, 0.4, 0.2)] if span > 2 else [mean * k for k in (1.4, 1.2, 1.1)]
    size, n, t, low = b["font_size"], len(b["words"]), b["t"], b["low"]
    score, level = next(((4 - k, f"H{k + 1}") for k, x in enumerate(limits) if size >= x), (1, "H3") if size > mean * 1.05 else (0, None))
    if b["is_bold"]:
        score, level = score + 2, level or "H3"
    if re.match(r"\d+\.\s+[A-Z]", t) and not any(w in low for w in C.FORM_WORDS):
        score, level = score + 3, "H2"
    elif re.match(r"\d+\.\d+\s+[A-Z]", t):
        score, level = score + 3, "H3"
    elif t.endswith(":") and n <= 6:
        score, level = score + 2, level or "H3"
    if n <= 3 and any(w in low for w in C.MAJOR):
        score, level = score + 6, "H2"
    if lang in ("japanese", "chinese"):
        if re.match(r"第\d+章", t):
            score, level = score + 5, "H1"
        elif re.match(r"第\d+[節节]", t):
            score, level = score + 4, "H2"
    score += 2 * any(w in low for w in C.SECTION_WORDS)
    score += 2 * (t.isupper() and 3 <= n <= 8)
    return score, level


def outline(blocks):
    """[(pos, level, text, page)], title, language and number of blocks of one document; None without blocks."""
    rows = rows_of(blocks)
    kept = unique(rows)
    if not kept:
        return None
    lang = Counter(language(b["t"]) for b in rows).most_common(1)[0][0]
    sizes = [b["font_size"] for b in kept if b["font_size"] > 0]
    mean, top = (sum(sizes) / len(sizes), max(sizes)) if sizes else (12, 12)
    found = []
    for b in kept:
        score, level = scored(b, mean, top, lang)
        if len(b["words"]) <= 20 and score >= 3 and level:
            found.append((b["page"], b["y0"], clean(b["t"]), level))
    for b in kept:
        level = next((v for p, v in C.SECTIONS if python(p).search(b["low"])), None)
        if level:
            found.append((b["page"], b["y0"], clean(b["t"]), level))
    found.sort(key=lambda h: h[:2])
    seen, heads = set(), []
    for page, _, text, level in found:
        if text and text.lower() not in seen:
            seen.add(text.lower())
            n = min(int(level[1]), int(heads[-1][1][1]) + 1) if heads else int(level[1])  # the first may be of any level
            heads.append((len(heads) + 1, f"H{n}", text, page + 1))
    return heads, title(kept, f"doc{blocks[0]['doc_id']}"), lang, len(kept)


def title(kept, fallback):
    first = sorted((b for b in kept if b["page"] == 0), key=lambda b: (-b["font_size"], b["y0"]))
    tidy = lambda t: re.sub(r"^(title|subject):\s*", "", re.sub(r"\s+", " ", t).strip(), flags=re.IGNORECASE)
    for b in first:
        if all(w in b["low"] for w in ("rfp", "request", "proposal")) and len(b["words"]) >= 10:
            return tidy(b["t"])
    for b in first[:15]:
        fits = 3 <= len(b["words"]) <= 25 and len(b["t"]) <= 200 and b["font_size"] >= 10 and not b["t"].endswith(".pdf")
        if fits and (any(w in b["low"] for w in C.TITLE_WORDS) or b["font_size"] >= 14 or b["is_bold"] or b["t"].isupper()):
            return tidy(b["t"])
    return fallback


def rules(blocks):
    """{seq: (font, style, position, pattern, context) scores} of one document's blocks with text."""
    rows = [b for b in rows_of(blocks) if b["t"]]
    sizes = [b["font_size"] for b in rows]
    mean, sd = statistics.fmean(sizes), statistics.pstdev(sizes)
    left, width, height = min(b["x0"] for b in rows), max(b["x1"] for b in rows), max(b["y0"] for b in rows)
    out = {}
    for b in rows:
        page = sorted((x for x in rows if x["page"] == b["page"]), key=lambda x: (x["y0"], x["seq"]))
        at = page.index(b)
        ratio, z = b["font_size"] / mean, (b["font_size"] - mean) / sd if sd > 0 else 0
        font = next((s for s, r, k in ((0.8, 1.4, 2), (0.6, 1.2, 1.5), (0.4, 1.1, 1)) if ratio >= r or z >= k), 0)
        n = len(b["words"])
        style = 0.4 * b["is_bold"] + 0.2 * b["is_italic"] + (0.6 if b["t"].isupper() and n <= 8 else 0.3 if b["t"].istitle() and n <= 12 else 0)
        gap = b["y0"] - page[at - 1]["y1"] if at else 0
        position = 0.3 * (abs(b["x0"] - left) <= 20) + 0.4 * (abs((b["x0"] + b["x1"]) / 2 - width / 2) <= width * 0.15) + 0.2 * (gap >= 15) + 0.1 * (height > 0 and b["y0"] / height <= 0.3)
        best = max((c * w for p, _, c, w in C.RULE_PATTERNS if python(p).search(b["low"])), default=0)
        near = sum(abs(x["x0"] - b["x0"]) < 10 for x in page) >= 2
        context = 0.2 * near + 0.3 * (at + 1 < len(page) and page[at + 1]["x0"] > b["x0"] + 10)
        out[b["seq"]] = tuple(round(x, 6) for x in (font, style, position, best, context))
    return out


def tidy_title(t):
    """The last clean-up of a ranked title."""
    t = re.sub(r"\.(pdf|doc|docx|txt)$", "", re.sub(r"^title[:\s]+", "", " ".join(t.split()), flags=re.IGNORECASE), flags=re.IGNORECASE)
    t = t[:1].upper() + t[1:]
    if len(t) > 100:
        words = t[:97].split()
        t = (" ".join(words[:-1]) if len(words) > 1 else t[:97]) + "..."
    return t.strip() or "Untitled Document"


def idf(n, df):
    return math.log((1 + n) / (1 + df)) + 1

"""Queries over whole texts against the rules in plain Python, one text at a time."""

import hashlib
import re

from groundq.plans import catalogue
from groundq.plans.views import table

SF = "/root/testdata/sf0.001"
LABEL, CHAPTER = r"[A-Za-z][\w\s\-]{0,80},\s*", r"(?:Ch\.|Chapter)\s*\d+.*$"


def without(text, reference):
    return re.sub(rf"\s+{reference}{CHAPTER}", "", text, flags=re.IGNORECASE).strip()


def cleaned(text):
    q = without(without(text.strip(), r"[a-z0-9][a-z0-9._-]*\.(?:txt|md|pdf)\s*,?\s*"), f"(?:{LABEL})?")
    return q[1:-1].strip() if len(q) >= 2 and q[0] in "\"'" and q[0] == q[-1] else q


def reformatted(raw):
    """Items of a raw answer. The references of the three file names that these answers hold are given."""
    refs = {"x_ch_07_of_power.txt": "Source, Ch. 7 — Of Power", "a.md": "a.md", "b_ch_08_y_s02_z.txt": "Source, Ch. 8 — Y, §2 — Z"}
    raw = re.split(r"\n\s*SOURCES\s*\(verified\)", raw, flags=re.IGNORECASE)[0]
    raw = re.sub(r"^\s*-{10,}\s*$", "", raw, flags=re.MULTILINE).strip()
    items, lines, file = [], [], None

    def flush():
        quote = without(" ".join(lines), LABEL)
        if quote:
            items.append(f"{quote}\n{refs[file]}" if file else quote)
        lines.clear()

    for line in [*(x.strip() for x in raw.split("\n")), ""]:
        if not line:
            flush()
            file = None
            continue
        if marker := re.search(r"【\d+:\d+†([^】]+)】", line):
            file = marker[1].strip()
            line = re.sub(r"【\d+:\d+†([^】]+)】", "", line).strip()
        if re.fullmatch(r"[a-z0-9][a-z0-9._-]*\.(txt|md|pdf)", line, re.IGNORECASE):
            file = line
            continue
        if line.startswith('"') and lines:
            flush()
            file = None
        lines.append(line)
    return "\n\n".join(items)


def test_whole_texts_go_through(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert sum("\n" in t for t in texts.values()) > len(texts) / 2
    tail = '" 【1:0†x_ch_07_of_power.txt】\n"two" 【2:1†a.md】\nwords Source, Ch. 9, §1\nb_ch_08_y_s02_z.txt\n\nSOURCES (verified)\n- file'
    wanted = {
        "strip_ref": lambda t: without(f"{t} Source, Ch. 13, §5", LABEL),
        "clean_quote": lambda t: cleaned(f'"{t}" corpus_ch_13_x_s05_y.txt, Ch. 13, §5'),
        "reformat_answer": lambda t: reformatted(f'"{t}{tail}'),
    }
    for name, rule in wanted.items():
        got = {row[0]: row[1] for row in catalogue.queries()[name](spark, SF).collect()}
        assert got == {i: hashlib.md5(rule(t).encode()).hexdigest() for i, t in texts.items()}, name

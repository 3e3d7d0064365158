"""Page boilerplate: templates of a host's pages from classes of tokens with equal occurrence vectors.

The tags of an extracted page are its line breaks and the marks that part the fields of a line; a token is what stands
between two of them, in its role: a whole line, the field before the first mark or after the last one, an item of a
chain. The occurrence vector of a token says on which lines of which pages of a host it stands. Tokens with the same
vector are one equivalence class; as they stand on the same lines, the roles put them in order. A class with a whole
line is closed; in one of fields only, what stands between them is a slot, and the lines that fill it are nested in the
class. A class is valid by its pages and hosts and, with a slot, by different fillings; two fields around a slot prove
more than one. The valid classes of a host, in the order of the lines, are its template; what isn't theirs are
the template's remaining slots, the body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.operators.skew import keyed_join
from tesserine.session import spread, written

#: A whole line is a template if it stands on so many pages and at least this share of the pages of its host, or on so
#: many hosts and at least this share of all their pages together.
LINE_PAGES, LINE_PAGE_SHARE, LINE_HOSTS, LINE_HOSTS_SHARE = 3, 0.003, 3, 0.015
#: A frame, if on so many pages and at least this share of the pages of its host, or of so many hosts and this share of all; with so many fillings.
FRAME_PAGES, FRAME_PAGE_SHARE, FRAME_HOSTS, FRAME_HOST_SHARE, FRAME_FILLINGS = 3, 0.02, 5, 0.02, 3
#: Below these shares the numbers alone do, if the line or frame is no chance filling of a slot: it has so many times the
#: pages (hosts) that those have on average which differ from it in names and numbers only.
STAND_OUT = 10
#: Fields of a class that are enough without a share, if it has the pages and fillings.
CLASS_FIELDS = 2
#: An item of a menu, if chained by marks on so many pages of its host or on so many hosts.
ITEM_PAGES, ITEM_HOSTS = 2, 2
#: Words of a field beside a slot at most; longer ones are text.
FRAME_WORDS = 5
#: A chain is a menu if this share of its items are valid.
ITEM_SHARE = 0.8

_LETTERS = re.compile(r"[^\W\d_]+")
_LINK = re.compile(r"\[([^\]\[]*)\]\([^()\s]*\)")
_CHAIN = re.compile(r"\s*(?:[|·•›»☰]|(?<=\s)[>/](?=\s))\s*")
_MARKS = re.compile(r"[|·•☰]|\s[>/]\s")
_NUMBER = re.compile(r"\s*\d{1,3}[.)]\s+(?=\S)")
_HEAD = re.compile(r"\s*([^:—–|()\[\]“”\"«»„\d]{2,}?)\s*(?::|—|–|\s-)\s+(?=\S)")
_CLOCK = re.compile(r"\s*\(\d+:\d+(?::\d+)?\)\s*[.]?\s*$")
_DIGIT = re.compile(r"\d")
_NO_LETTER = bytes(b for b in range(128) if not (97 <= b <= 122))
_BEYOND = bytes(range(128, 256))
_QUOTES = re.compile("[" + re.escape("’‘“”„«»‹›–—…·•☰|\u00a0\u00ad\u2009\u200b\u202f\ufeff") + "]+")
_HIGH = re.compile(rb"[\x80-\xff]+")


def line_key(line: str) -> str:
    """Letters in lower case; where most are ASCII, other runs become wildcards, so that wrong decodings don't matter."""
    low = line.lower()
    if low.isascii():
        return low.encode().translate(None, _NO_LETTER).decode()
    low = _QUOTES.sub("", low)
    raw = low.encode("utf-8", "replace").translate(None, _NO_LETTER)
    n = len(raw.translate(None, _BEYOND))
    if n >= 0.7 * (n + (len(raw) - n) / 2):
        return _HIGH.sub(b"*", raw).decode().strip("*")
    return "".join(_LETTERS.findall(low))


def site_key(host: str) -> str:
    """Letters of a host without www., m., blog. and the last label."""
    labels = [x for x in host.lower().split(".") if x not in ("www", "m", "blog", "amp")]
    return line_key("".join(labels[:-1] or labels))


def host_of(domain: str | None, url: str | None) -> str:
    host = domain or re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().lower()).split("/")[0].split("?")[0]
    return re.sub(r"^(?:www\.|m\.)+", "", host.strip().lower())


def page_of(url: str | None, chunk: str) -> str:
    """The address without scheme, host, parameters, fragment and page number, or else the text itself."""
    path = re.sub(r"^[a-z][a-z0-9+.-]*://[^/?#]*", "", (url or "").strip().lower()).split("#")[0].split("?")[0].strip("/")
    return re.sub(r"/page/\d+$", "", unquote(path)) or line_key(chunk)


def menu_items(line: str) -> list[str]:
    """Items of a line that is a chain of links or of short items between marks; else none."""
    if "](" in line and (links := _LINK.findall(line)) and not _LETTERS.search(_LINK.sub("", line)):
        return [x for x in links if line_key(x)]
    if not _MARKS.search(line):
        return []
    parts = [x for x in _CHAIN.split(line) if line_key(x)]
    return parts if len(parts) >= 3 or (len(parts) == 2 and ">" in line) else []


def frames(line: str) -> list[tuple[str, str]]:
    """``(frame, filling)`` of a line with a slot: after its head, before its tail, or within a lone link."""
    if "](" in line and _LINK.search(line):
        return [("[](/)", line_key(line))] if not _LETTERS.search(_LINK.sub("", line)) else []
    out = []
    if m := _NUMBER.match(line):
        out.append(("#.*", line_key(line[m.end() :])))
    elif (m := _HEAD.match(line)) and len(m.group(1).split()) <= FRAME_WORDS and (k := line_key(m.group(1))):
        out.append((f"{k}*", line_key(line[m.end() :])))
    if m := _CLOCK.search(line):
        out.append(("*(#)", line_key(line[: len(line) - len(m.group())])))
    elif (tail := line.rstrip(" .\r"))[-1:] in "›»" and "«" not in line:
        out.append(("*›", line_key(tail)))
    if "|" in line and len((tail := line.rpartition("|")[2]).split()) <= FRAME_WORDS and (k := line_key(tail)):
        out.append((f"*{k}", line_key(line.rpartition("|")[0])))
    return out


def family(fixed: str) -> str:
    """A line or the fixed part of a frame without names, that is capitals within it; fillings of one slot share it.

    Of words all in capitals the first two are kept; a lone word may be a name, so all of these are one family.
    """
    words = [w for w in fixed.split() if w[0].isalpha() or _LETTERS.search(w)]
    if len(words) == 1:
        return "*"
    kept = words[: 1 + (fixed.upper() == fixed)]
    for w in words[len(kept) :]:
        c = w[0] if w[0].isalnum() else w.lstrip("“„«\"'(")[:1]
        if not c.isupper():
            kept.append(w)
    return line_key(" ".join(kept))


def _fixed(frame: str, line: str) -> str:
    """The words of a frame as they stand in the line."""
    if frame[-1] == "*" and (m := _HEAD.match(line)):
        return m.group(1)
    return line.rpartition("|")[2] if frame[0] == "*" and "|" in line else ""


def features(host: str, chunk: str) -> Iterator[tuple[int, int, str, str, int, str]]:
    """``(line_no, kind, template, filling, of, family)`` of each line.

    Kind 0: the whole line, with its neighbours as filling; 1: a frame; 2: an item of a chain; 3: a word of a short line without marks; 4: a word of an
    item. ``of``: how many items or words the line has, or letters the family.
    """
    site = site_key(host)

    def own(k: str) -> str:
        return k.replace(site, "@") if len(site) > 3 else k

    texts = chunk.split("\n")
    keys = [line_key(line) for line in texts]
    filled = [i for i, key in enumerate(keys) if key]
    for at, i in enumerate(filled):
        no, line, key = i + 1, texts[i], keys[i]
        beside = (keys[filled[at - 1]][-40:] if at else "") + "\n" + (keys[filled[at + 1]][:40] if at + 1 < len(filled) else "")
        fam = own(family(line))
        yield no, 0, own(key), beside, len(fam), fam
        for f, filling in frames(line):
            fam = own(family(_fixed(f, line)) or f)
            yield no, 1, own(f), filling, len(fam), fam
        items = menu_items(line)
        for item in items:
            yield no, 2, line_key(item), "", len(items), ""
        if len(items) > 2:
            for w in {k for item in items for w in item.split() if (k := line_key(w))}:
                yield no, 4, w, "", 1, ""
        if not items and (line.rstrip()[-1:] not in ".?!”“\"»:" or line.rstrip().endswith(" .")):
            words = set() if _DIGIT.search(line) else {k for w in set(line.split()) if (k := line_key(w))}
            if len(words) >= 2:
                for w in words:
                    yield no, 3, w, "", len(words), ""


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    h = xxhash.xxh64_intdigest
    for b in batches:
        cols: list[list[int]] = [[] for _ in range(9)]
        for rid, domain, url, chunk in zip(*(c.to_pylist() for c in b.columns)):
            host = host_of(domain, url)
            hh, page = h(host), h(page_of(url, chunk))
            for no, kind, template, filling, of, fam in features(host, chunk):
                for col, v in zip(cols, (rid, no, kind, hh, page, h(template, min(kind, 3)), h(filling) if filling else 0, of, h(fam) if fam else 0)):
                    col.append(v)
        n = [pa.array(c, pa.uint64()).cast(pa.int64(), safe=False) if i in (3, 4, 5, 6, 8) else pa.array(c, pa.int64() if i == 0 else pa.int32()) for i, c in enumerate(cols)]
        yield pa.RecordBatch.from_arrays(n, names=["id", "line_no", "kind", "host", "page", "t", "f", "of", "fam"])


_SCHEMA = "id long, line_no int, kind int, host long, page long, t long, f long, of int, fam long"


def template_lines(df: DataFrame, id_col: str, domain: str, url: str, text: str) -> DataFrame:
    """``(id, line_no)`` of each line that reduces to a valid template of its host's pages.

    Null and empty texts have no lines, blank lines and those without letters are never found. Without a domain the
    host is that of the address; without an address the text stands for the page; rows without both share one host.
    Rows repeated add no page. A row's lines are judged by hashes of 64 bits; only hashes are shuffled, counted with
    map-side combining, and a template that a third of all lines share is found again by a salted join.
    """
    texts = df.filter(F.length(text) > 0).select(F.col(id_col).cast("long"), F.col(domain).cast("string"), F.col(url).cast("string"), F.col(text))
    feats = written(spread(texts).mapInArrow(_features, _SCHEMA), "features")
    tokens = written(_tokens(feats), "tokens")
    kept = _classes(_recurring(tokens))
    hosts = written(feats.filter("kind = 0").select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")), "hosts")
    n_hosts = hosts.count()
    per_host = written(keyed_join(kept, hosts, ["host"], "host_pages", F.col("t"), row_bytes=24), "per_host")
    over = per_host.groupBy("kind", "t").agg(F.count(F.lit(1)).alias("hosts"), F.sum("fillings").alias("all_fillings"), (F.sum("pages") / F.sum("host_pages")).alias("share"))
    s = keyed_join(per_host, written(over, "over"), ["kind", "t"], "hosts", F.col("host"), row_bytes=48)
    line = (F.col("pages") >= F.greatest(F.lit(LINE_PAGES), F.col("host_pages") * LINE_PAGE_SHARE)) | ((F.col("hosts") >= LINE_HOSTS) & (F.col("share") >= LINE_HOSTS_SHARE))
    filled = (F.col("pages") >= FRAME_PAGES) & (F.col("fillings") >= FRAME_FILLINGS)
    own = filled & ((F.col("pages") >= F.col("host_pages") * FRAME_PAGE_SHARE) | (F.col("fields") >= CLASS_FIELDS))
    widely = (F.col("hosts") >= FRAME_HOSTS) & (F.col("all_fillings") >= FRAME_FILLINGS)
    shared = widely & (F.col("hosts") >= FRAME_HOST_SHARE * n_hosts)
    item = (F.col("pages") >= ITEM_PAGES) | (F.col("hosts") >= ITEM_HOSTS)
    valid = s.filter(F.when(F.col("kind") == 0, line).when(F.col("kind") == 1, own | shared).otherwise(item))
    few = written(s.filter(F.when(F.col("kind") == 0, ~line & (F.col("pages") >= LINE_PAGES)).when(F.col("kind") == 1, ~(own | shared) & (filled | widely)).otherwise(F.lit(False))), "few")
    valid = written(valid.select("kind", "t", "host", "n").unionByName(_standing_out(few, tokens, feats)), "valid")
    hit = keyed_join(feats.filter("kind < 3"), valid, ["kind", "t", "host"], "n", F.col("id"), row_bytes=40)
    whole = hit.filter("kind < 2").select("id", "line_no")
    chained = hit.filter("kind = 2").groupBy("id", "line_no").agg(F.count(F.lit(1)).alias("n"), F.max("of").alias("of")).filter(F.col("n") >= ITEM_SHARE * F.col("of")).select("id", "line_no")
    # chains without marks: all words of the line are words of items
    words = feats.filter("kind = 4").select("t", "host", "page").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= ITEM_PAGES)
    spelt = keyed_join(feats.filter("kind = 3"), written(words, "words"), ["t"], "n", F.col("id"), row_bytes=24)
    unmarked = spelt.groupBy("id", "line_no").agg(F.count(F.lit(1)).alias("n"), F.max("of").alias("of")).filter("n = of").select("id", "line_no")
    return whole.unionByName(chained).unionByName(unmarked).distinct()


def _tokens(feats: DataFrame) -> DataFrame:
    """``(kind, t, host, pages, n, fam, v1, v2, fillings)``: each token of a host with its occurrence vector.

    The vector, the lines a token stands on, is kept as two sums of hashes beside the number of pages and lines.
    """
    place = [F.pmod(F.xxhash64("id", "line_no", F.lit(seed)), F.lit(1 << 31)) for seed in (1, 2)]
    of_page = feats.filter("kind < 3").groupBy("kind", "t", "host", "page").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("of", "fam")).alias("fam"), F.sum(place[0]).alias("v1"), F.sum(place[1]).alias("v2"))
    of_host = of_page.groupBy("kind", "t", "host").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"), F.min("fam")["fam"].alias("fam"), F.sum("v1").alias("v1"), F.sum("v2").alias("v2"))
    fillings = feats.filter("kind = 1").select("kind", "t", "host", "f").distinct().groupBy("kind", "t", "host").agg(F.count(F.lit(1)).alias("fillings"))
    return of_host.join(fillings, ["kind", "t", "host"], "left").withColumn("fillings", F.coalesce("fillings", F.lit(1).cast("long")))


def _recurring(tokens: DataFrame) -> DataFrame:
    """Tokens with the pages, over all hosts, that the least condition asks for."""
    often = tokens.groupBy("kind", "t").agg(F.sum("pages").alias("all_pages"), F.count(F.lit(1)).alias("hosts")).filter(F.col("all_pages") >= F.when(F.col("kind") == 2, ITEM_PAGES).otherwise(LINE_PAGES))
    return keyed_join(tokens, written(often, "often"), ["kind", "t"], "hosts", F.col("host"), row_bytes=32).drop("all_pages", "hosts")


def _classes(tokens: DataFrame) -> DataFrame:
    """Tokens with the number of fields beside a slot that their equivalence class has; none in a closed one."""
    of = Window.partitionBy("host", "n", "v1", "v2")
    closed = F.max((F.col("kind") == 0).cast("int")).over(of) == 1
    return tokens.withColumn("fields", F.when(closed, 0).otherwise(F.count_if(F.col("kind") == 1).over(of)))


def _standing_out(few: DataFrame, tokens: DataFrame, feats: DataFrame) -> DataFrame:
    """``(kind, t, host, n)`` of those with a small share of pages or hosts that don't recur as fillings of a slot do.

    A line or frame is held against the others of its family on its own host, a frame of several hosts against the
    others of its family by their hosts; a line must have different neighbours, as copied passages have not. Shares of unrelated pages and hosts have no part in it.
    """
    kin = tokens.filter("kind < 2").groupBy("kind", "fam", "host").agg(F.count(F.lit(1)).alias("kin"), F.sum("pages").alias("kin_pages"))
    wide = tokens.filter("kind = 1").groupBy("fam", "t").agg(F.count(F.lit(1)).alias("m")).groupBy("fam").agg(F.count(F.lit(1)).alias("wide"), F.sum("m").alias("wide_hosts"))
    lines = few.filter("kind = 0").select("t", "host")
    beside = feats.filter("kind = 0").join(lines, ["t", "host"], "left_semi").groupBy("t", "host").agg(F.countDistinct("f").alias("beside")).withColumn("kind", F.lit(0))
    x = few.join(beside, ["kind", "t", "host"], "left").join(kin, ["kind", "fam", "host"]).join(wide.withColumn("kind", F.lit(1)), ["kind", "fam"], "left")
    enough = F.when(F.col("kind") == 0, F.col("beside") >= LINE_PAGES).otherwise((F.col("pages") >= FRAME_PAGES) & (F.col("fillings") >= FRAME_FILLINGS))
    by_pages = enough & (F.col("pages") * (F.col("kin") - 1) >= STAND_OUT * (F.col("kin_pages") - F.col("pages")))
    by_hosts = (F.col("kind") == 1) & (F.col("hosts") >= FRAME_HOSTS) & (F.col("all_fillings") >= FRAME_FILLINGS) & (F.col("hosts") * (F.col("wide") - 1) >= STAND_OUT * (F.col("wide_hosts") - F.col("hosts")))
    return x.filter(by_pages | by_hosts).select("kind", "t", "host", "n")

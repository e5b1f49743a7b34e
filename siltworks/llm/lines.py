"""Lines that repeat across the pages of one site, found with suffix arrays over line identifiers."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.urls import page_key, site_of
from siltworks.operators.skew import sized_join
from siltworks.session import ensure_checkpoint_dir

LEAST_PAGES, SHARE = 3, 20
SHARD_PAGES = 1500


def line_form(line: Column) -> Column:
    """The form in which lines are the same: lower case, one space per run of blanks, trimmed, digit runs as 0."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), "[ \\t\\r\\u00a0]+", " ")), "[0-9]+", "0")


def page_lines(pages: DataFrame) -> DataFrame:
    """``site, page, raw, forms``: the lines of each row that has content and whose url names a page."""
    key = page_key(pages["url"])
    split = pages.where(pages["content"].isNotNull()).select(key.alias("page"), F.split("content", "\n").alias("raw")).where("page is not null")
    return split.select(site_of(F.col("page")).alias("site"), "page", "raw", F.transform("raw", line_form).alias("forms"))


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes and their common prefix lengths with the suffix before, by prefix doubling in numpy.

    The ranks of every doubling step are kept and give the common prefixes by binary lifting. A symbol that occurs once
    (each document's separator) ends every comparison.
    """
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    steps = [rank]
    width = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: max(n - width, 0)] = rank[width:]
        both = rank * (n + 1) + after + 1
        order = np.argsort(both, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(both[order][1:] != both[order][:-1])])
        rank = new
        if n == 0 or rank[order[-1]] == n - 1:
            break
        steps.append(rank)
        width *= 2
    common = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(steps) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[ok] = steps[k][a[ok]] == steps[k][b[ok]]
        common[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, common


def repeated_blocks(symbols: np.ndarray, pages: np.ndarray, least: np.ndarray | int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each depth the blocks of that many lines: (first positions, distinct pages, is maximal).

    ``symbols`` holds line ids >= 0 and one distinct negative separator behind each document; ``pages`` the page number
    of each position. Depth 1 lists every line; deeper ones list blocks on at least ``least`` pages (of the block's
    first line). A block is maximal if no longer block starts with it on as many pages.
    """
    order, common = suffix_array(symbols)
    out = []
    keep = symbols[order] >= 0
    depth = 1
    counts_before: tuple[np.ndarray, np.ndarray] | None = None
    while keep.any():
        head = ~keep | ~np.concatenate([[False], keep[:-1]]) | (common < depth)
        group = np.cumsum(head) - 1
        inside = np.flatnonzero(keep)
        pairs = np.unique(np.stack([group[inside], pages[order[inside]]]), axis=1)
        count = np.bincount(pairs[0], minlength=group[-1] + 1)
        heads = np.flatnonzero(head & keep)
        n = count[group[heads]]
        first = order[heads]
        enough = n >= (least if np.isscalar(least) else least[first])
        if counts_before is not None:
            at, longest = counts_before
            np.maximum.at(longest, np.searchsorted(at, heads[enough], side="right") - 1, n[enough])
            prev = out[-1]
            out[-1] = (prev[0], prev[1], longest < prev[1])
        show = enough if depth > 1 else np.ones(len(heads), bool)
        out.append((first[show], n[show], np.ones(int(show.sum()), bool)))
        counts_before = (heads[show], np.zeros(int(show.sum()), np.int64))
        alive = np.zeros(len(count), bool)
        alive[group[heads[enough]]] = True
        size = np.bincount(group[inside], minlength=len(count))
        keep = keep & alive[group] & (size[group] > 1)
        depth += 1
        nxt = order + depth - 1
        ok = nxt < len(symbols)
        live = np.zeros(len(order), bool)
        live[ok] = symbols[nxt[ok]] >= 0
        keep &= live
        # only what is still alive goes on; behind a gap a new group starts
        counts_before = ((np.cumsum(keep) - keep)[counts_before[0]], counts_before[1])
        common = np.where(np.concatenate([[False], keep[:-1]]), common, 0)[keep]
        order, keep = order[keep], keep[keep]
    return out


def prefix_blocks(runs: list[np.ndarray], pages: np.ndarray, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As repeated_blocks, for blocks of two lines and more that begin where a run of lines begins: (runs, distinct pages, is maximal).

    ``pages`` and ``least`` belong to the runs. All runs that begin with a line have to be here, so that counts are final.
    """
    sizes = np.array([len(r) for r in runs])
    flat, starts = np.concatenate(runs), np.cumsum(sizes) - sizes
    codes, page_no = np.unique(flat, return_inverse=True)[1].astype(np.int64), np.unique(pages, return_inverse=True)[1]
    live, group, depth, out = np.arange(len(runs)), codes[starts], 1, []
    while True:
        live, group = live[sizes[live] > depth], group[sizes[live] > depth]
        if not len(live):
            return out
        both = np.stack([group, codes[starts[live] + depth]])
        keys, first, new = np.unique(both, axis=1, return_index=True, return_inverse=True)
        new = new.reshape(-1)
        pairs = np.unique(np.stack([new, page_no[live]]), axis=1)
        count = np.bincount(pairs[0], minlength=len(first))
        enough = count >= least[live[first]]
        if out:
            longest = np.zeros(len(out[-1][0]), np.int64)
            np.maximum.at(longest, keys[0][enough], count[enough])
            out[-1] = (out[-1][0], out[-1][1], longest < out[-1][1])
        out.append((live[first[enough]], count[enough], np.ones(int(enough.sum()), bool)))
        number = np.cumsum(enough) - 1
        live, group = live[enough[new]], number[new[enough[new]]]
        depth += 1


def _no_blocks() -> pd.DataFrame:
    return pd.DataFrame({"site_id": np.zeros(0, np.int64), "n_lines": np.zeros(0, np.int32), "block": pd.Series([], dtype=object), "n_pages": np.zeros(0, np.int64)})


def _prefix_blocks(batch: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one bucket of runs of frequent lines; a site's runs with one first line are in one bucket."""
    runs, sites = list(batch["run"]), batch["site_id"].to_numpy()
    frames = [_no_blocks()]
    for depth, (first, n, maximal) in enumerate(prefix_blocks(runs, batch["page"].to_numpy(), batch["least"].to_numpy()), 2):
        blocks = [runs[i][:depth] for i in first[maximal]]
        frames.append(pd.DataFrame({"site_id": sites[first[maximal]], "n_lines": np.int32(depth), "block": pd.Series(blocks, dtype=object), "n_pages": n[maximal]}))
    return pd.concat(frames)


def _runs(ids: pd.Series, found: pd.Series) -> pd.Series:
    """For each page the runs of at least two frequent lines from each start to the run's end."""
    out = []
    for lines, good in zip(ids, found, strict=True):
        ok = np.concatenate([np.isin(lines, good), [False]])
        end = np.flatnonzero(~ok)
        at = np.flatnonzero(ok)
        out.append([lines[a:b] for a, b in zip(at, end[np.searchsorted(end, at)], strict=True) if b - a > 1])
    return pd.Series(out)


def _site_blocks(batch: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one bucket of whole sites, and lines of one bucket of shards of large sites."""
    ids = batch["ids"].to_numpy()
    sizes = np.array([len(x) for x in ids])
    if not sizes.sum():
        return _no_blocks()
    lines = np.concatenate(ids)
    known, codes = np.unique(lines, return_inverse=True)
    ends = np.cumsum(sizes)
    symbols = np.insert(codes.astype(np.int64), ends, -np.arange(1, len(ids) + 1))
    doc = np.repeat(np.arange(len(ids)), sizes + 1)
    page_no = np.unique(batch["page"].to_numpy(), return_inverse=True)[1]
    pages, sites = page_no[doc], batch["site_id"].to_numpy()[doc]
    least = np.maximum(LEAST_PAGES, -(-batch["local_pages"].to_numpy() // SHARE))[doc]
    frames = [_no_blocks()]
    for depth, (first, n, maximal) in enumerate(repeated_blocks(symbols, pages, least), 1):
        # a whole site's blocks can be judged here; a shard's lines all leave, to be added up
        whole = batch["whole"].to_numpy()[doc[first]]
        use = (~whole | (n >= least[first])) if depth == 1 else maximal & whole
        if not use.any():
            continue
        blocks = known[symbols[first[use][:, None] + np.arange(depth)[None, :]]]
        frames.append(pd.DataFrame({"site_id": sites[first[use]], "n_lines": np.int32(depth), "block": pd.Series(list(blocks), dtype=object), "n_pages": n[use]}))
    return pd.concat(frames)


def _rows(pages: DataFrame) -> DataFrame:
    """``site, site_id, page, ids`` of each row: hashes of its non-empty lines."""
    ids = F.transform(F.filter("forms", lambda x: x != ""), lambda x: F.xxhash64(F.col("site"), x))
    return page_lines(pages).select("site", F.xxhash64("site").alias("site_id"), F.xxhash64("page").alias("page"), ids.alias("ids"))


def _judged(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Frequent blocks of whole sites and frequent lines of sharded ones, the sizes of the sites (written), and the number of buckets."""
    ensure_checkpoint_dir(rows.sparkSession)
    sizes = rows.groupBy("site", "site_id").agg(F.count_distinct("page").alias("site_pages"))
    sites = sizes.withColumn("shards", F.expr(f"int((site_pages + {SHARD_PAGES - 1}) div {SHARD_PAGES})")).checkpoint()
    buckets = max(1, (sites.agg(F.sum("site_pages")).first()[0] or 0) // SHARD_PAGES)
    small = sites.drop("site")
    placed = (
        sized_join(rows.drop("site"), small, "site_id", F.col("page"), F.lit(24))
        .withColumn("shard", F.pmod("page", F.col("shards").cast("long")))
        .withColumn("bucket", F.pmod(F.hash("site_id", "shard"), F.lit(buckets)))
        .withColumn("local_pages", F.expr("site_pages div shards"))
        .withColumn("whole", F.col("shards") == 1)
    )
    found = placed.select("bucket", "site_id", "page", "ids", "local_pages", "whole").groupBy("bucket").applyInPandas(_site_blocks, "site_id long, n_lines int, block array<long>, n_pages long")
    # the lines of shards are combined before they meet their site's size
    summed = found.groupBy("site_id", "n_lines", "block").agg(F.sum("n_pages").alias("n_pages"))
    judged = sized_join(summed, sites, "site_id", F.hash("block"), F.length("site") + 24)
    return judged.where(f"n_pages >= {LEAST_PAGES} and n_pages * {SHARE} >= site_pages"), sites, buckets


def site_blocks(pages: DataFrame) -> DataFrame:
    """``site, site_id, n_lines, block, n_pages, site_pages``: repeated blocks of line ids per site.

    Each site's pages are concatenated and suffix-sorted; sites of more than SHARD_PAGES pages are cut into shards by
    page. Common prefixes of the sorted suffixes give the blocks, one line long or more. Pages are never cut, so a
    line's pages add up over the shards and counts of one-line blocks are exact. Longer blocks of a sharded site consist
    of its frequent lines: the suffixes of its runs of such lines are brought together by their first line, so every
    block is counted, and found maximal, over the whole site. Blocks have any length.
    """
    rows = _rows(pages)
    judged, sites, buckets = _judged(rows)
    judged = judged.checkpoint()
    columns = ["site", "site_id", "n_lines", "block", "n_pages", "site_pages"]
    good = judged.where("shards > 1 and n_lines = 1").groupBy("site_id", "site_pages", "shards").agg(F.collect_set(F.col("block")[0]).alias("found"))
    suffixes = F.pandas_udf(_runs, "array<array<long>>")
    # sites of many pages only, each with at most SHARE times a page's lines
    runs = rows.join(F.broadcast(good), "site_id").select("site_id", "page", "site_pages", "shards", F.explode(suffixes("ids", "found")).alias("run")).distinct()
    least = F.greatest(F.lit(LEAST_PAGES).cast("long"), F.expr(f"(site_pages + {SHARE - 1}) div {SHARE}"))
    first_lines = runs.select(F.pmod(F.hash("site_id", F.col("run")[0]), F.lit(buckets)).alias("bucket"), "site_id", "page", least.alias("least"), "run")
    deep = first_lines.groupBy("bucket").applyInPandas(_prefix_blocks, "site_id long, n_lines int, block array<long>, n_pages long")
    return judged.select(*columns).unionByName(sized_join(deep, sites, "site_id", F.hash("block"), F.length("site") + 24).select(*columns))


def frequent_line_ids(pages: DataFrame) -> DataFrame:
    """``site_id, found``: ids of the lines in frequent blocks; at most SHARE times a page's lines per site. Written before it is given back."""
    # each line of a frequent block is a frequent block of its own
    judged, _, _ = _judged(_rows(pages))
    lines = judged.where("n_lines = 1").select("site_id", F.explode("block").alias("line_id"))
    return lines.groupBy("site_id").agg(F.collect_set("line_id").alias("found")).checkpoint()


def _with_found(rows: DataFrame, found: DataFrame, record: Column, how: str) -> DataFrame:
    return sized_join(rows, found, "site_id", record, F.size("found") * 8, how)


def repeated_lines(pages: DataFrame) -> DataFrame:
    """``site, line``: lines of frequent blocks, in the form of line_form.

    A line is frequent on at least LEAST_PAGES pages and a SHARE-th of the site's pages; pages are distinct crawl keys
    with content, of all their rows. Null contents, urls that name no page, and empty lines take no part; repeated
    rows of a page count once; an empty table gives no rows.
    """
    own = page_lines(pages).select(F.xxhash64("site").alias("site_id"), "site", "page", F.array_distinct("forms").alias("forms"))
    hits = _with_found(own, frequent_line_ids(pages), F.col("page"), "inner").select(
        "site", F.explode(F.filter("forms", lambda x: (x != "") & F.array_contains("found", F.xxhash64(F.col("site"), x)))).alias("line")
    )
    return hits.distinct()


def without_repeated_lines(pages: DataFrame) -> DataFrame:
    """``page_id, url, kept, removed``: content without the lines of frequent blocks, and how many went.

    Every line of a frequent block is frequent by itself, so blocks go line by line. Rows without content keep null;
    rows whose url names no page keep all lines. Blank lines stay.
    """
    site = site_of(page_key(pages["url"]))
    rows = pages.select("page_id", "url", "content", site.alias("site"), F.xxhash64(site).alias("site_id"))
    joined = _with_found(rows, frequent_line_ids(pages), F.xxhash64("url", "page_id"), "left")
    bad = lambda x: F.coalesce((line_form(x) != "") & F.array_contains("found", F.xxhash64(F.col("site"), line_form(x))), F.lit(False))
    raw = F.split("content", "\n")
    kept = F.filter(raw, lambda x: ~bad(x))
    return joined.select("page_id", "url", F.array_join(kept, "\n").alias("kept"), (F.size(raw) - F.size(kept)).alias("removed"))

"""DuckDB counterparts of the registered queries. An operator without one is tested against brute force."""

OP3_KDTREE_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pair AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pair QUALIFY rank <= 10
"""

OP8_WARC_CHUNKS = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
lead AS (SELECT body, max(page_id) AS leader FROM p WHERE octet_length(body) >= 1000 GROUP BY body)
SELECT p.page_id, CAST(octet_length(p.body) AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
  CASE WHEN p.page_id < leader THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < leader THEN leader END AS refers_to
FROM p LEFT JOIN lead ON p.body = lead.body
"""

OP6_LINE_NEIGHBOURS = r"""
WITH line AS (
  SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), norm AS (
  SELECT *, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS norm FROM line
), uniq AS (
  SELECT norm, length(norm) AS n, min((doc_id, line_no)) AS first FROM norm WHERE length(norm) >= 20 GROUP BY norm
), half AS (
  SELECT norm, n, first, n AS base, left(norm, CAST(n // 2 AS INT)) AS part, 'l' AS side FROM uniq
  UNION ALL SELECT norm, n, first, n, right(norm, CAST(n - n // 2 AS INT)), 'r' FROM uniq
  UNION ALL SELECT norm, n, first, n - 1, left(norm, CAST((n - 1) // 2 AS INT)), 'l' FROM uniq
  UNION ALL SELECT norm, n, first, n - 1, right(norm, CAST(n - 1 - (n - 1) // 2 AS INT)), 'r' FROM uniq
), near AS (
  SELECT DISTINCT a.norm FROM half a JOIN half b ON a.base = b.base AND a.side = b.side AND a.part = b.part
  WHERE b.first < a.first AND levenshtein(a.norm, b.norm) <= 1
), kept AS (
  SELECT m.doc_id, m.line_no, m.line,
    length(m.norm) < 20 OR (n.norm IS NULL AND (m.doc_id, m.line_no) = u.first) AS kept
  FROM norm m LEFT JOIN uniq u ON m.norm = u.norm LEFT JOIN near n ON m.norm = n.norm
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN kept THEN 0 ELSE 1 END) AS BIGINT) AS n_dropped,
  md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE kept), '')) AS text_md5
FROM kept GROUP BY doc_id
"""


def mixing_sql(documents: str, weights: list[tuple[tuple[str, ...], int]], share: tuple[int, int], max_epochs: int, seed: int) -> str:
    """Selection of a three-level mix; ``documents`` is a relation with columns doc_id, text, domain, lang, source."""
    name = "'=' || {0}"
    paths = [" || chr(31) || ".join(name.format(c) for c in ("domain", "lang", "source")[: i + 1]) for i in range(3)]
    listed = ", ".join("(" + " || chr(31) || ".join(f"'={v}'" for v in path) + f", {w})" for path, w in weights)
    ctes = [
        f"tok AS (SELECT doc_id, domain, lang, source, {paths[0]} AS p1, {paths[1]} AS p2, {paths[2]} AS p3, "
        f"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM {documents})",
        f"wt(path, weight) AS (VALUES {listed})",
        "leaf AS (SELECT p1, p2, p3, sum(tokens)::BIGINT AS tokens FROM tok GROUP BY ALL)",
        f"b0 AS (SELECT '' AS path, least(sum(tokens)::BIGINT * {share[0]} // {share[1]}, sum(tokens)::BIGINT * {max_epochs}) AS budget FROM leaf)",
    ]
    for d in (1, 2, 3):
        parent = "''" if d == 1 else f"p{d - 1}"
        ctes += [
            f"n{d} AS (SELECT p{d} AS path, {parent} AS parent, sum(tokens)::BIGINT * {max_epochs} AS capacity FROM leaf GROUP BY ALL)",
            f"o{d} AS (SELECT n.*, coalesce(w.weight, 1)::BIGINT AS weight, b.budget AS total FROM n{d} n JOIN b{d - 1} b ON n.parent = b.path "
            "LEFT JOIN wt w ON n.path = w.path)",
            f"s{d} AS (SELECT *, total - coalesce(sum(capacity) OVER prior, 0)::BIGINT AS lt, "
            f"sum(weight) OVER (PARTITION BY parent)::BIGINT - coalesce(sum(weight) OVER prior, 0)::BIGINT AS lw FROM o{d} WHERE weight > 0 "
            "WINDOW prior AS (PARTITION BY parent ORDER BY capacity / weight, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
            f"f{d} AS (SELECT *, bool_and(lt * weight >= capacity * lw) OVER (PARTITION BY parent ORDER BY capacity / weight, path) AS full_ FROM s{d})",
            f"b{d} AS (SELECT path, CASE WHEN full_ THEN capacity ELSE ((total - coalesce(sum(capacity) FILTER (full_) OVER fam, 0)::BIGINT) * weight) "
            f"// (sum(weight) FILTER (NOT full_) OVER fam)::BIGINT END AS budget FROM f{d} WINDOW fam AS (PARTITION BY parent))",
        ]
    ctes += [
        "plan AS (SELECT l.p3, b.budget // l.tokens AS whole, b.budget % l.tokens AS part FROM leaf l JOIN b3 b ON l.p3 = b.path WHERE l.tokens > 0)",
        f"ord AS (SELECT t.*, whole, part, md5('{seed}:' || whole || ':' || doc_id) AS okey FROM tok t JOIN plan p ON t.p3 = p.p3)",
        "run AS (SELECT *, sum(tokens) OVER (PARTITION BY p3 ORDER BY okey) - sum(tokens) OVER (PARTITION BY p3, okey) AS start FROM ord)",
    ]
    return "WITH " + ", ".join(ctes) + (
        " SELECT doc_id, domain, lang, source, tokens, CAST(whole + CASE WHEN start < part THEN 1 ELSE 0 END AS INTEGER) AS epochs "
        "FROM run WHERE whole > 0 OR start < part"
    )


#: Weights of the registered mix; every other node has weight 1.
MIX_WEIGHTS = [(("d0",), 5), (("d1",), 3), (("d2",), 2), (("d0", "en"), 3), (("d1", "en"), 4), (("d1", "de"), 2), (("d2", "fr"), 6), (("d0", "en", "src0"), 9)]
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (4, 5), 2, 17
MIX_DOMAIN = "'d' || (ascii(right(source, 1)) % 3)"
OP2_HIERARCHICAL_MIX = mixing_sql(f"(SELECT *, {MIX_DOMAIN} AS domain FROM documents)", MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def _leak_sql() -> str:
    from terradrift.llm.templates import TOKEN, UNITS

    units = ", ".join(f"'{u}'" for u in UNITS)
    number = "regexp_matches({0}, '^[0-9]')"
    kind = (
        f"CASE WHEN {number.format('w[i]')} THEN '<number>' WHEN i > 1 AND {number.format('w[i - 1]')} AND lower(w[i]) IN ({units}) THEN '<unit>' "
        "WHEN left(w[i], 1) <> left(lower(w[i]), 1) THEN '<name>' ELSE lower(w[i]) END"
    )
    token = TOKEN.replace("'", "''")

    def templates(source: str, key: str) -> str:
        return (
            f"SELECT {key}, w, list_transform(range(1, len(w) + 1), lambda i: {kind}) AS t FROM "
            f"(SELECT {key}, regexp_extract_all(coalesce(text, ''), '{token}') AS w FROM {source})"
        )

    return f"""
    WITH item0 AS ({templates('benchmark', 'item_id')}),
    item AS (SELECT min(item_id) AS item_id, arg_min(w, item_id) AS w, t, least(len(t), 10) AS size FROM item0 WHERE len(w) > 0 GROUP BY t),
    iw AS (SELECT item_id, size, unnest(range(len(t) - size + 1)) AS pos, t FROM item),
    iwin AS (SELECT item_id, size, pos AS ipos, t[pos + 1 : pos + size] AS win FROM iw
      WHERE len(list_filter(t[pos + 1 : pos + size], lambda x: x IN ('<number>', '<name>', '<unit>'))) * 2 <= size),
    total AS (SELECT item_id, count(*) AS n FROM iwin GROUP BY item_id),
    doc AS ({templates('documents', 'doc_id')}),
    dw AS (SELECT doc_id, size, t, unnest(range(len(t) - size + 1)) AS pos FROM doc, (SELECT DISTINCT size FROM item) WHERE len(t) >= size),
    dwin AS (SELECT doc_id, size, pos, t[pos + 1 : pos + size] AS win FROM dw),
    pass AS (SELECT doc_id, item_id, pos - ipos AS shift, count(*) AS n_windows, min(ipos) AS first, max(ipos) + any_value(size) AS last
      FROM dwin JOIN iwin USING (size, win) GROUP BY ALL),
    span AS (SELECT p.*, list_filter(list_zip(i.t[first + 1 : last], i.w[first + 1 : last], d.w[first + shift + 1 : last + shift]),
        lambda z: z[1] IN ('<number>', '<name>', '<unit>')) AS slots
      FROM pass p JOIN total USING (item_id) JOIN item i USING (item_id) JOIN doc d USING (doc_id) WHERE n_windows >= least(3, n)),
    good AS (SELECT * FROM span WHERE
      len(list_distinct(slots)) = len(list_distinct(list_transform(slots, lambda z: (z[1], z[2])))) AND
      len(list_distinct(list_transform(list_filter(slots, lambda z: z[1] = '<name>'), lambda z: (z[2], z[3]))))
        = len(list_distinct(list_transform(list_filter(slots, lambda z: z[1] = '<name>'), lambda z: z[3]))))
    SELECT doc_id, item_id, max((n_windows, len(slots)))[1] AS n_windows, CAST(max((n_windows, len(slots)))[2] AS INTEGER) AS n_slots,
      max(len(list_filter(slots, lambda z: z[2] <> z[3])) = 0) AS exact FROM good GROUP BY doc_id, item_id
    """


OP10_BENCHMARK_TEMPLATES = _leak_sql()


OP9_JACCARD_PREFIXES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE list_transform(range(1, len(w) - 3), lambda i: w[i : i + 4]) END) AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
tok AS (SELECT doc_id, unnest(s) AS t FROM s),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM tok a JOIN tok b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.id, w.b FROM reach r JOIN ways w ON r.other = w.a)
SELECT n.doc_id, n AS n_shingles, c AS component_id FROM n JOIN (SELECT id, min(other) AS c FROM reach GROUP BY id) ON id = n.doc_id
"""


OP11_BLOOM_DEDUP = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM t WINDOW same AS (PARTITION BY t)
"""

#: CRC-32 of a text of one-byte characters: ``crc_table`` is a relation of one list, ``CRC32`` an expression over its column ``k`` and a text ``s``.
CRC_TABLE = (
    "crc_table AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), "
    "lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))) AS k)"
)
CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({s}, ''), lambda c: CAST(ascii(c) AS BIGINT))), "
    "lambda a, b: xor(a >> 8, {k}[CAST(xor(a, b) & 255 AS INT) + 1])))"
)


def merkle_sql(levels: int) -> str:
    """Leaves, roots and proofs level by level, for groups of at most 3 ** levels rows and as many groups."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END"
    head = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    text, cut = field.format("text"), field.format("replace(text, chr(10), '')")
    ctes = [
        CRC_TABLE,
        f"doc AS (SELECT doc_id, source, sha256({head} || {text}) AS leaf, CASE WHEN {CRC32.format(s='CAST(doc_id AS VARCHAR)', k='k')} % 2 = 0 "
        f"THEN sha256({head} || {cut}) END AS alt FROM documents, crc_table)",
        "a0 AS (SELECT CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS t, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, alt) - 1 AS i,"
        " count(*) OVER (PARTITION BY source) AS w, * FROM doc)",
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            ctes.append(
                f"{name}{k + 1} AS (SELECT t, i // 3 AS i, CASE WHEN max(w) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h, "
                f"CAST((max(w) + 2) // 3 AS BIGINT) AS w FROM {name}{k} GROUP BY t, i // 3)"
            )
            ctes.append(
                f"{name}s{k} AS (SELECT x.t, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i < x.i), '') AS l, "
                f"coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i > x.i), '') AS r, max(x.w) > 1 AS many "
                f"FROM {name}{k} x JOIN {name}{k} y ON x.t = y.t AND x.i // 3 = y.i // 3 GROUP BY x.t, x.i)"
            )

    def fold(name: str, start: str, keep: str) -> None:
        ctes.append(f"{name}f0 AS ({start})")
        for k in range(levels):
            ctes.append(
                f"{name}f{k + 1} AS (SELECT f.* EXCLUDE (i, h, p), f.i // 3 AS i, p || l || r AS p, CASE WHEN many THEN sha256(l || h || r) ELSE h END AS h "
                f"FROM {name}f{k} f JOIN {name}s{k} s ON f.{keep} = s.t AND f.i = s.i)"
            )

    climb("a")
    ctes.append(f"b0 AS (SELECT 'all' AS t, t AS source_key, h, row_number() OVER (ORDER BY encode(t)) - 1 AS i, count(*) OVER () AS w FROM a{levels})")
    climb("b")
    fold("a", "SELECT doc_id, t, leaf, i, coalesce(alt, leaf) AS h, '' AS p FROM a0", "t")
    fold("b", f"SELECT f.doc_id, f.t AS source_key, 'all' AS t, f.leaf, b.h AS subroot, b.i, f.h, f.p FROM af{levels} f JOIN b0 b ON f.t = b.source_key", "t")
    return "WITH " + ",\n".join(ctes) + (
        f"\nSELECT f.doc_id, leaf, subroot, b.h AS root, sha256(p) AS proof_sha256, f.h AS folded_root, f.h = b.h AS verified FROM bf{levels} f, b{levels} b"
    )


OP13_MERKLE_MANIFEST = merkle_sql(11)

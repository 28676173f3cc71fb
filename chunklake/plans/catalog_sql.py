"""DuckDB SQL for the queries of catalog_queries."""

from __future__ import annotations

from chunklake.functions import kernels

#: The fixture tables, by the rules of fixtures.
_TABLES = r"""
WITH RECURSIVE entries AS (
  SELECT doc_id AS ord, 'doc-' || doc_id AS uid, sha256(text) AS id, 'doc_' || doc_id || '.txt' AS name, source AS grp,
         lang || '/doc_' || doc_id || '.txt' AS rel_path, '/arquivos/' || source AS folder,
         '/arquivos/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path,
         '/src/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS source_path,
         strlen(text)::BIGINT AS size, sha256(text) || '.pack' AS pack_file, (strlen(text) * 37 // 100 + 64)::BIGINT AS stored_size,
         CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'blocks' END AS storage,
         CASE lang WHEN 'en' THEN '/codebooks/vault.codebook' WHEN 'fr' THEN '/codebooks/fr.codebook' ELSE '' END AS codebook,
         CASE lang WHEN 'en' THEN 'vault' WHEN 'fr' THEN 'fr' ELSE '' END AS book,
         ((doc_id * 7) % 101)::DOUBLE AS hit_rate, CASE WHEN doc_id % 10 = 0 THEN 493 ELSE 420 END AS mode,
         CASE WHEN doc_id % 5 = 0 THEN sha256(text) || '.pack' ELSE 'blocks:' || sha256(text) END AS content_key, lang
  FROM documents
), contents AS (
  SELECT sha256(text) AS content_id, min(doc_id) AS ord, min(text) AS text FROM documents GROUP BY 1
), recipes AS (
  SELECT content_id, ord, seq, sha256(piece) AS chunk_id, strlen(piece)::BIGINT AS len
  FROM (SELECT content_id, ord, i::INT AS seq, substring(text, i * 2000 + 1, 2000) AS piece
        FROM (SELECT *, unnest(range(greatest(length(text) - 1, 0) // 2000 + 1)) AS i FROM contents WHERE text <> ''))
), chunk_base AS (
  SELECT chunk_id, (('0x' || substr(chunk_id, 1, 2))::INT % 8)::INT AS seg, (('0x' || substr(chunk_id, 3, 2))::BIGINT % 16 * 1048576)::BIGINT AS frame_off,
         ('0x' || substr(chunk_id, 5, 1))::INT < 2 AS d, max(len) AS size, ('0x' || substr(chunk_id, 6, 7))::BIGINT AS log_pos
  FROM recipes GROUP BY chunk_id
), chunk_index AS (
  SELECT chunk_id, seg, frame_off, size, d AND base IS NOT NULL AS is_delta, CASE WHEN d THEN base END AS base_id, log_pos
  FROM chunk_base LEFT JOIN (SELECT seg, frame_off, min(chunk_id) AS base FROM chunk_base WHERE NOT d GROUP BY ALL) USING (seg, frame_off)
), frames AS (
  SELECT seg, frame_off, (seg % 3)::INT AS codec, raw_len, (raw_len * 2 // 5)::BIGINT AS comp_len
  FROM (SELECT seg, frame_off, (sum(size) + count(*) * 32 + CASE WHEN seg % 3 = 0 THEN sum(size) ELSE 0 END)::BIGINT AS raw_len FROM chunk_index GROUP BY seg, frame_off)
  UNION ALL SELECT DISTINCT seg, 99 * 1048576::BIGINT, 1, 1000::BIGINT, 400::BIGINT FROM chunk_index
), recipe_log AS (
  SELECT ord * 3 + k AS log_pos, CASE WHEN k = 1 THEN 2 WHEN strlen(text) <= 4096 THEN 3 ELSE 1 END::INT AS op, content_id, ord % 50 = 3 AS bad
  FROM contents, (VALUES (0), (1), (2)) t(k) WHERE k = 0 OR (k = 1 AND ord % 7 = 0) OR (k = 2 AND ord % 14 = 0)
), standing AS (
  SELECT content_id, max_by(op, log_pos) AS op, max(log_pos) AS log_pos FROM recipe_log WHERE NOT bad GROUP BY content_id
), live AS (
  SELECT * FROM standing WHERE op <> 2
), live_recipes AS (
  SELECT * FROM recipes WHERE content_id IN (SELECT content_id FROM live)
), marked AS (
  SELECT chunk_id FROM live_recipes UNION SELECT base_id FROM chunk_index WHERE is_delta
), features AS (
  SELECT chunk_id, k::INT AS slot, ('0x' || substr(chunk_id, (8 + 4 * k)::INT, 3))::BIGINT % 500 + k * 1000 AS f, log_pos FROM chunk_index, (VALUES (0), (1), (2)) t(k)
), bases AS (
  SELECT f, max_by(chunk_id, (log_pos, chunk_id)) AS base_id FROM features GROUP BY f
), usage AS (
  SELECT f.seg, f.frame_off, raw_len AS all_bytes, coalesce(live_bytes, 0)::BIGINT AS live_bytes
  FROM frames f LEFT JOIN (SELECT seg, frame_off, sum(size) AS live_bytes FROM chunk_index WHERE chunk_id IN (SELECT chunk_id FROM marked) GROUP BY ALL) u USING (seg, frame_off)
), gc_f AS (
  SELECT *, live_bytes > 0 AND (all_bytes - live_bytes)::DOUBLE < 0.3::DOUBLE * all_bytes AS verbatim FROM usage
), gc_s AS (
  SELECT *, all_bytes = 0 OR live_bytes = 0 OR (reclaim_bytes > 0 AND reclaim_bytes::DOUBLE / all_bytes::DOUBLE >= 0.3::DOUBLE) AS rewrite
  FROM (SELECT seg, sum(all_bytes)::BIGINT AS all_bytes, sum(live_bytes)::BIGINT AS live_bytes, sum(CASE WHEN verbatim THEN 0 ELSE all_bytes - live_bytes END)::BIGINT AS reclaim_bytes FROM gc_f GROUP BY seg)
), folders AS (
  SELECT DISTINCT path FROM (
    SELECT '/' AS path UNION ALL SELECT '/arquivos' UNION ALL SELECT folder FROM entries
    UNION ALL SELECT unnest(['/arquivos/empty/deep', '/notes', '/.Trash-1000', '/arquivos/.Trash/x']))
), tree AS (
  SELECT path FROM folders
  UNION SELECT CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END FROM tree WHERE path <> '/'
), implied AS (
  SELECT DISTINCT folder || '/' || lang AS path FROM entries UNION SELECT folder FROM entries UNION SELECT '/arquivos' UNION SELECT '/'
), codebooks AS (
  SELECT * FROM (VALUES ('vault', 2048::BIGINT, true), ('spare', 512::BIGINT, false)) t(name, size, is_default)
), pack_files AS (
  SELECT pack_file AS file, stored_size AS size FROM entries WHERE storage = '' AND ord % 15 <> 0
  UNION SELECT 'loose-' || pack_file, size FROM entries WHERE storage = '' AND ord % 20 = 0
), asked AS (
  SELECT path FROM entries UNION SELECT unnest(['/', '/arquivos', '/arquivos/src1/en', '/none', '/.Trash-1000', '/notes', '/arquivos/empty'])
), kinds AS (
  SELECT path, CASE WHEN path = '/' THEN 'dir' WHEN contains(path || '/', '/.Trash-') OR contains(path || '/', '/.Trash/') THEN 'none'
                    WHEN path IN (SELECT path FROM folders) THEN 'dir' WHEN path IN (SELECT path FROM entries) THEN 'file'
                    WHEN path IN (SELECT path FROM implied) THEN 'dir' ELSE 'none' END AS kind
  FROM asked
)
"""


def _human(x: str) -> str:
    steps = " ".join(f"WHEN {x} >= 1024::HUGEINT ** {k} THEN printf('%.1f', round_even({x}::DOUBLE / {1024**k}::DOUBLE, 1)) || ' {u}'" for k, u in reversed(list(enumerate(("KB", "MB", "GB", "TB", "PB", "EB"), 1))))
    return f"CASE {steps} ELSE {x}::VARCHAR || ' B' END"


_BODIES = {
    "stats_overview": """
SELECT a.*, s.stored_bytes FROM (
  SELECT sum(n)::BIGINT AS files, count(*) AS unique_contents, sum(size)::BIGINT AS original_bytes, sum(one)::BIGINT AS unique_bytes,
         (sum(size) - sum(one))::BIGINT AS dedup_saved_bytes, round(coalesce(sum(ratios) / nullif(sum(filled), 0), 0), 6)::DOUBLE AS avg_ratio
  FROM (SELECT id, count(*) AS n, sum(size) AS size, min_by(size, ord) AS one, sum(CASE WHEN size > 0 THEN stored_size::DOUBLE / size * 100 END) AS ratios, count_if(size > 0) AS filled FROM entries GROUP BY id)) a,
 (SELECT sum(stored)::BIGINT AS stored_bytes FROM (SELECT min_by(stored_size, ord) AS stored FROM entries GROUP BY content_key)) s""",
    "codebook_stats": """
SELECT book AS codebook, members, unique_contents, original_bytes, stored_bytes, original_bytes - stored_bytes AS saved_bytes,
       round(CASE WHEN original_bytes = 0 THEN 0 ELSE 100.0::DOUBLE * (stored_bytes::DOUBLE / original_bytes::DOUBLE) END, 6)::DOUBLE AS ratio, avg_hit,
       coalesce(c.size, 0)::BIGINT AS db_size, coalesce(c.is_default, false) AS is_default
FROM (SELECT book, count(*) AS members, count_if(first)::BIGINT AS unique_contents, sum(size)::BIGINT AS original_bytes,
             coalesce(sum(CASE WHEN first THEN stored_size END), 0)::BIGINT AS stored_bytes, round(avg(hit_rate), 6) AS avg_hit
      FROM (SELECT *, ord = min(ord) OVER (PARTITION BY content_key) AS first FROM entries) GROUP BY book) e
LEFT JOIN codebooks c ON c.name = e.book""",
    "package_report": """
SELECT grp AS package, count(*) AS files, sum(size)::BIGINT AS original_bytes, sum(stored_size)::BIGINT AS stored_bytes, min_by(codebook, ord) AS codebook, min(ord) AS first_ord,
       string_agg(CASE WHEN n <= 6 THEN name END, ',' ORDER BY ord) AS first_names,
       round(CASE WHEN sum(size) = 0 THEN 0 ELSE 100.0::DOUBLE * (sum(stored_size)::DOUBLE / sum(size)::DOUBLE) END, 6)::DOUBLE AS ratio
FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ord) AS n FROM entries) GROUP BY grp""",
    "store_stats": """
SELECT (SELECT count(*) FROM chunk_index) AS chunks, (SELECT count(*) FROM live) AS contents, count(*) AS segments, sum((bytes + 511) // 512 * 512)::BIGINT AS allocated_bytes
FROM (SELECT seg, sum(comp_len) AS bytes FROM frames GROUP BY seg)""",
    "content_info": "SELECT content_id, count(*) AS chunks, count(DISTINCT chunk_id) AS distinct_chunks, sum(len)::BIGINT AS size, (sum(len) // count(*))::BIGINT AS mean_chunk FROM recipes GROUP BY content_id",
    "dup_contents": "SELECT id, count(*) AS copies, min(ord) AS first_ord, (sum(size) - min_by(size, ord))::BIGINT AS saved_bytes FROM entries GROUP BY id HAVING count(*) > 1",
    "size_rollup": "SELECT grp AS package, lang, count(*) AS files, sum(size)::BIGINT AS bytes, grouping(grp, lang)::INT AS level FROM entries GROUP BY ROLLUP (grp, lang)",
    "bundle_meta": """SELECT grp AS "group", min_by(codebook, ord) AS codebook, count(*) AS members, sum(size)::BIGINT AS bytes,
       sum(('0x' || substr(md5(rel_path || ':' || size || ':' || id), 1, 15))::BIGINT)::VARCHAR AS members_sum FROM entries GROUP BY grp""",
    "bundle_members": 'SELECT grp AS "group", rel_path AS name, size, id AS sha256 FROM entries',
    "match_term": "SELECT * FROM (SELECT CASE WHEN starts_with(id, 'doc_1') OR name = 'doc_1' OR grp = 'doc_1' OR rel_path = 'doc_1' THEN 0 WHEN contains(name, 'doc_1') OR contains(grp, 'doc_1') OR contains(rel_path, 'doc_1') THEN 1 END AS rank, ord, name FROM entries) WHERE rank IS NOT NULL",
    "match_package": """SELECT * FROM (SELECT CASE WHEN starts_with(id, 'src1') OR lower(grp) = 'src1' OR lower(name) = 'src1' OR lower(rel_path) = 'src1' THEN 0 WHEN contains(lower(grp), 'src1') OR contains(lower(name), 'src1') OR contains(lower(rel_path), 'src1') THEN 1 END AS rank, ord, grp AS "group" FROM entries) WHERE rank IS NOT NULL""",
    "grep_lines": """
SELECT ord, (i - 1)::BIGINT AS line_no,
       CASE WHEN strlen(line) <= 300 THEN line ELSE substring(line, 1, list_max(list_filter(range(0, 301), lambda k: strlen(substring(line, 1, k::INT)) <= 300))::INT) || '…' END AS line
FROM (SELECT ord, i, regexp_replace(lines[i], '\\r$', '') AS line, n FROM (SELECT doc_id AS ord, string_split(text, chr(10)) AS lines, len(string_split(text, chr(10))) AS n, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
WHERE NOT (line = '' AND i = n) AND contains(lower(line), 'license')""",
    "search_capped": """
SELECT ord, (i - 1)::BIGINT AS line_no, CASE WHEN strlen(line) <= 300 THEN line ELSE substring(line, 1, list_max(list_filter(range(0, 301), lambda k: strlen(substring(line, 1, k::INT)) <= 300))::INT) || '…' END AS line
FROM (SELECT ord, i, regexp_replace(lines[i], '\\r$', '') AS line, n FROM (SELECT ord, lines, len(lines) AS n, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id AS ord, string_split(text, chr(10)) AS lines FROM documents ORDER BY doc_id LIMIT 40)))
WHERE NOT (line = '' AND i = n) AND contains(lower(line), 'the') ORDER BY ord, line_no LIMIT 50""",
    "entries_in_folder": "SELECT ord, path FROM entries WHERE folder = '/arquivos/src1' OR starts_with(folder, '/arquivos/src1/')",
    "sub_folders": "SELECT DISTINCT split_part(substr(path, 11), '/', 1) AS name FROM folders WHERE starts_with(path, '/arquivos/')",
    "open_dir": "SELECT DISTINCT 'dir' AS kind, lang AS name FROM entries WHERE grp = 'src1'",
    "lookup_path": "SELECT path, kind FROM kinds",
    "path_stat": "SELECT k.path, kind, CASE kind WHEN 'dir' THEN 493 WHEN 'file' THEN (CASE WHEN mode & 73 <> 0 THEN 493 ELSE 420 END) ELSE 0 END::INT AS mode, CASE kind WHEN 'file' THEN size ELSE 0 END::BIGINT AS size FROM kinds k LEFT JOIN entries e ON e.path = k.path",
    "folder_tree": "SELECT path, CASE WHEN path = '/' THEN '' WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent, CASE WHEN path = '/' THEN '' ELSE regexp_extract(path, '[^/]*$') END AS name, CASE WHEN path = '/' THEN 0 ELSE len(string_split(path, '/')) - 1 END::INT AS depth FROM tree",
    "entry_ancestors": "SELECT f.path, count(*) AS entries, sum(size)::BIGINT AS bytes FROM folders f JOIN entries e ON f.path = '/' OR e.folder = f.path OR starts_with(e.folder, f.path || '/') GROUP BY f.path",
    "trash_folders": "SELECT path, contains(path || '/', '/.Trash-') OR contains(path || '/', '/.Trash/') AS is_trash FROM tree WHERE path IN (SELECT path FROM folders)",
    "human_sizes": f"SELECT ord, {_human('size')} AS size_text, {_human('(size * size)')} AS large_text FROM entries",
    "canonical_paths": "SELECT ord, CASE ord % 4 WHEN 0 THEN '/' || rel_path WHEN 1 THEN folder || '/' || rel_path WHEN 2 THEN folder || '//' || rel_path ELSE '//' || rel_path END AS path FROM entries",
    "archive_paths": "SELECT ord, ord % 3 <> 0 AS is_archive, CASE WHEN ord % 3 <> 0 THEN folder ELSE '' END AS folder, CASE WHEN ord % 3 <> 0 THEN grp ELSE '' END AS grp, CASE WHEN ord % 3 <> 0 THEN rel_path ELSE '' END AS rel FROM entries",
    "entry_forms": "SELECT ord, content_key, book AS codebook, CASE WHEN mode & 73 <> 0 THEN 493 ELSE 420 END::INT AS mode, substr(sha256(path || id), 1, 16) AS uid, round(CASE WHEN size = 0 THEN 0 ELSE 100.0::DOUBLE * (stored_size::DOUBLE / size::DOUBLE) END, 6)::DOUBLE AS ratio, regexp_full_match(id, '[0-9a-fA-F]{64}') AS is_id, name AS base FROM entries",
    "hit_rates": "SELECT ord, CASE WHEN ord % 9 = 0 THEN 0 ELSE ((ord % 100)::VARCHAR || '.' || (ord % 10)::VARCHAR)::DOUBLE END AS hit_rate FROM entries",
    "rename_folder": "SELECT ord, CASE WHEN grp = 'src1' THEN '/moved/one' ELSE folder END AS folder, CASE WHEN grp = 'src1' THEN '/moved/one/' || rel_path ELSE path END AS path FROM entries",
    "renamed_folders": "SELECT DISTINCT CASE WHEN path = '/arquivos/src1' OR starts_with(path, '/arquivos/src1/') THEN '/moved/one' || substr(path, 15) ELSE path END AS path FROM folders",
    "delete_folder": "SELECT ord, CASE WHEN grp = 'src2' THEN '/arquivos' ELSE folder END AS folder, CASE WHEN grp = 'src2' THEN '/arquivos/' || name ELSE path END AS path FROM entries",
    "move_entry": "SELECT ord, CASE WHEN uid = 'doc-5' THEN '/notes' ELSE folder END AS folder, CASE WHEN uid = 'doc-5' THEN '/notes/' || rel_path ELSE path END AS path FROM entries",
    "rename_entry": """SELECT ord, CASE WHEN uid = 'doc-7' THEN 'new.txt' ELSE name END AS name, CASE WHEN uid = 'doc-7' THEN '/arquivos/renamed' ELSE folder END AS folder,
       CASE WHEN uid = 'doc-7' THEN '/arquivos/renamed/sub/new.txt' ELSE path END AS path, CASE WHEN uid = 'doc-7' THEN 'renamed' ELSE grp END AS "group" FROM entries""",
    "bundle_errors": "SELECT DISTINCT rel_path AS name, e.id AS sha256 FROM entries e JOIN contents c ON c.content_id = e.id WHERE c.ord % 13 IN (1, 2)",
    "may_work": "SELECT event_id, event_id * 37 % 1200 >= 600 AND event_id % 40 / 10.0 <= 2.4 AND event_id * 11 % 2000 >= 768 AND event_id % 9 <> 0 AS may_work FROM events",
    "rename_group": """SELECT ord, CASE WHEN grp = 'src3' THEN 'renamed' ELSE grp END AS "group", CASE WHEN grp = 'src3' THEN '/arquivos/renamed/' || rel_path ELSE path END AS path FROM entries""",
    "create_folder": "SELECT path FROM folders UNION SELECT unnest(['/', '/deep', '/deep/new', '/deep/new/folder'])",
    "add_plan": """
SELECT n.source_path, n.id, CASE WHEN t.source_path IS NOT NULL THEN 'imported' WHEN k.id IS NOT NULL THEN 'dedup' ELSE 'new' END AS status, coalesce(k.stored_size, 0)::BIGINT AS stored_size
FROM (SELECT source_path, grp, rel_path, id FROM entries WHERE ord % 2 = 0
      UNION ALL SELECT '/new' || source_path, grp, rel_path, CASE WHEN ord % 3 = 0 THEN sha256(uid) ELSE id END FROM entries WHERE ord % 2 = 1) n
LEFT JOIN (SELECT DISTINCT source_path, grp, rel_path FROM entries WHERE ord % 4 <> 2) t USING (source_path, grp, rel_path)
LEFT JOIN (SELECT id, min_by(stored_size, ord) AS stored_size FROM entries WHERE ord % 4 <> 2 GROUP BY id) k ON k.id = n.id""",
    "replace_paths": "SELECT ord, path, size FROM entries WHERE ord % 5 <> 0 UNION ALL SELECT ord + 1000000, path, size + 1 FROM entries WHERE ord % 5 = 0",
    "remove_release": "SELECT DISTINCT content_key FROM entries WHERE ord % 4 = 0 AND content_key NOT IN (SELECT content_key FROM entries WHERE ord % 4 <> 0)",
    "remove_keep": "SELECT ord, uid FROM entries WHERE ord % 4 <> 0",
    "merge_manifest": """
SELECT coalesce(d.uid, m.uid) AS uid, CASE WHEN coalesce(m.dirty, false) THEN 'local_' || m.name ELSE d.name END AS name, CASE WHEN d.uid IS NULL THEN 1 ELSE 0 END::INT AS side, coalesce(d.ord, m.ord) AS place
FROM (SELECT * FROM entries WHERE ord % 10 <> 0) d FULL JOIN (SELECT *, ord % 3 = 0 AS dirty, ord % 11 = 0 AS gone FROM entries WHERE ord % 10 <> 1) m ON d.uid = m.uid
WHERE NOT coalesce(m.gone, false) AND (d.uid IS NOT NULL OR m.dirty)""",
    "merge_folders": "SELECT path FROM folders WHERE length(path) % 3 <> 0 AND length(path) % 5 <> 0 UNION SELECT path FROM folders WHERE length(path) % 3 <> 1 AND length(path) % 2 = 0",
    "extract_plan": "SELECT min(ord) AS ord, '/out/' || grp || '/' || rel_path AS target, min_by(CASE WHEN mode & 73 <> 0 THEN 493 ELSE 420 END, ord)::INT AS mode, CASE WHEN bool_or(ord % 6 = 0) THEN 'exists' ELSE 'write' END AS status FROM entries GROUP BY id, grp, rel_path",
    "recipe_log_compaction": "SELECT content_id, op, log_pos FROM live",
    "recipe_log_health": "SELECT count(*) AS records, count_if(bad)::BIGINT AS bad_records, (count(*) - count_if(bad) - (SELECT count(*) FROM standing) + (SELECT count_if(op = 2) FROM standing))::BIGINT AS dead_records, (SELECT count_if(op = 2) FROM standing)::BIGINT AS deleted FROM recipe_log",
    "index_last_wins": "SELECT chunk_id, CASE WHEN log_pos % 3 = 0 THEN seg + 8 ELSE seg END::INT AS seg, frame_off, CASE WHEN log_pos % 3 = 0 THEN log_pos + 300000000 ELSE log_pos END AS log_pos FROM chunk_index",
    "running_offsets": "SELECT content_id, seq, (sum(len) OVER (PARTITION BY content_id ORDER BY seq) - len)::BIGINT AS start, len FROM recipes",
    "read_range": """
SELECT content_id, seq, greatest(off - start, 0)::BIGINT AS skip, (least(len, off + 2500 - start) - greatest(off - start, 0))::BIGINT AS take
FROM (SELECT content_id, seq, len, (sum(len) OVER (PARTITION BY content_id ORDER BY seq) - len)::BIGINT AS start, (sum(len) OVER (PARTITION BY content_id) // 3)::BIGINT AS off FROM recipes)
WHERE start < off + 2500 AND start + len > off""",
    "mark_live": "SELECT chunk_id FROM marked",
    "garbage": "SELECT count(*) AS chunks, coalesce(sum(size), 0)::BIGINT AS bytes FROM chunk_index WHERE chunk_id NOT IN (SELECT chunk_id FROM marked)",
    "orphan_bases": """
SELECT base_id, count(*) AS deltas, sum(size)::BIGINT AS delta_bytes, any_value((SELECT b.size FROM chunk_index b WHERE b.chunk_id = i.base_id)) AS base_size
FROM chunk_index i WHERE is_delta AND chunk_id IN (SELECT chunk_id FROM live_recipes) AND base_id NOT IN (SELECT chunk_id FROM live_recipes) GROUP BY base_id""",
    "delta_bases": "SELECT i.chunk_id, i.base_id, b.size AS base_size, b.is_delta AS base_is_delta FROM chunk_index i JOIN chunk_index b ON b.chunk_id = i.base_id WHERE i.is_delta",
    "frame_usage": "SELECT seg, frame_off, all_bytes, live_bytes FROM usage",
    "gc_segments": "SELECT seg, all_bytes, live_bytes, reclaim_bytes, rewrite FROM gc_s",
    "gc_plan": "SELECT i.chunk_id, i.size, CASE WHEN NOT s.rewrite THEN 'keep' WHEN f.verbatim THEN 'copy' WHEN i.chunk_id IN (SELECT chunk_id FROM marked) THEN 'move' ELSE 'drop' END AS fate FROM chunk_index i JOIN gc_s s USING (seg) JOIN gc_f f USING (seg, frame_off)",
    "segment_budget": "SELECT seg, bytes, upto FROM (SELECT *, (sum(bytes) OVER (ORDER BY seg))::BIGINT AS upto, row_number() OVER (ORDER BY seg) AS n FROM (SELECT seg, sum(comp_len)::BIGINT AS bytes FROM frames GROUP BY seg HAVING bool_or(codec = 1))) WHERE n = 1 OR upto <= 300000",
    "segment_list": "SELECT DISTINCT seg FROM frames",
    "frame_headers": "SELECT seg, frame_off, codec, raw_len FROM frames",
    "newest_bases": "SELECT f, base_id FROM bases",
    "delta_candidates": "SELECT chunk_id, min_by(base_id, slot) AS base_id FROM features JOIN bases USING (f) WHERE base_id <> chunk_id GROUP BY chunk_id",
    "usable_candidates": "SELECT chunk_id, min_by(base_id, slot) AS base_id FROM features JOIN bases USING (f) WHERE base_id <> chunk_id AND base_id IN (SELECT chunk_id FROM chunk_index WHERE NOT is_delta) AND base_id IN (SELECT chunk_id FROM marked) GROUP BY chunk_id",
    "compacted_features": "SELECT DISTINCT chunk_id, slot, f FROM features WHERE chunk_id IN (SELECT chunk_id FROM chunk_index WHERE NOT is_delta)",
    "one_block_contents": "SELECT content_id, count(*) = 1 AS one_block, CASE WHEN count(*) = 1 THEN 45 ELSE 69 + 36 * count(*) END::BIGINT AS record_bytes FROM recipes GROUP BY content_id",
    "dangling_entries": "SELECT ord, id FROM entries WHERE storage = 'blocks' AND id NOT IN (SELECT content_id FROM live)",
    "orphan_files": "SELECT file, size FROM pack_files WHERE file NOT IN (SELECT pack_file FROM entries WHERE storage = '')",
    "missing_codebooks": "SELECT ord, book FROM entries WHERE book <> '' AND book NOT IN (SELECT name FROM codebooks)",
    "dup_uids": "SELECT uid, 2::BIGINT AS n FROM entries WHERE ord % 13 = 0",
    "doctor": """
SELECT 'bad_records' AS "check", 'error' AS severity, count(*) AS n FROM recipe_log WHERE bad
UNION ALL SELECT 'dangling_entries', 'error', count(*) FROM entries WHERE storage = 'blocks' AND id NOT IN (SELECT content_id FROM live)
UNION ALL SELECT 'duplicate_uids', 'error', count(*) FROM (SELECT uid FROM entries GROUP BY uid HAVING count(*) > 1)
UNION ALL SELECT 'garbage_chunks', 'info', count(*) FROM chunk_index WHERE chunk_id NOT IN (SELECT chunk_id FROM marked)
UNION ALL SELECT 'missing_codebooks', 'warning', count(*) FROM entries WHERE book <> '' AND book NOT IN (SELECT name FROM codebooks)
UNION ALL SELECT 'no_default_codebook', 'warning', 0
UNION ALL SELECT 'orphan_files', 'warning', count(*) FROM pack_files WHERE file NOT IN (SELECT pack_file FROM entries WHERE storage = '')""",
    "recipe_sums": "SELECT c.content_id, (strlen(text) + CASE WHEN c.ord % 17 = 0 THEN 1 ELSE 0 END)::BIGINT AS size FROM contents c WHERE c.ord % 17 = 0",
    "contents_list": "SELECT content_id FROM live",
    "entry_by_id": "SELECT id, min(ord) AS ord, min_by(uid, ord) AS uid FROM entries GROUP BY id",
    "reference_counts": "SELECT pack_file, count(*) AS n FROM entries WHERE storage = '' GROUP BY pack_file",
    "optimize_candidates": """
SELECT chunk_id, size FROM chunk_index
WHERE NOT is_delta AND size >= 1024 AND chunk_id IN (SELECT chunk_id FROM live_recipes) AND log_pos % 4 <> 0
  AND chunk_id NOT IN (SELECT base_id FROM chunk_index WHERE is_delta) AND chunk_id NOT IN (SELECT min(chunk_id) FROM live_recipes GROUP BY content_id HAVING count(*) = 1)""",
    "position_order": "SELECT seg, frame_off, chunk_id FROM chunk_index",
    "stale_spool": "SELECT e.path FROM entries e WHERE TIMESTAMP '2024-01-01' + to_minutes(ord) < TIMESTAMP '2024-01-02 10:00:00' - INTERVAL 24 HOUR",
    "codebook_list": "SELECT * FROM codebooks",
    "manifest_json": """SELECT ord, '{"uid":"' || uid || '","id":"' || id || '","name":"' || name || '","size":' || size || '}' AS line FROM entries""",
    "clean_folders": "SELECT path FROM folders",
    "saved_by_delta": """
SELECT o.base_id, base_size + delta_bytes AS keep, change, change < base_size + delta_bytes AS apply
FROM (SELECT base_id, sum(size)::BIGINT AS delta_bytes, any_value((SELECT b.size FROM chunk_index b WHERE b.chunk_id = i.base_id)) AS base_size
      FROM chunk_index i WHERE is_delta AND chunk_id IN (SELECT chunk_id FROM live_recipes) AND base_id NOT IN (SELECT chunk_id FROM live_recipes) GROUP BY base_id) o
JOIN (SELECT base_id, sum(size // 2 + 40)::BIGINT AS change FROM chunk_index WHERE is_delta GROUP BY base_id) r USING (base_id)""",
    "piece_dedup": """
SELECT c.content_id, coalesce(a.chunks, 0) AS chunks, coalesce(a.size, 0)::BIGINT AS size, coalesce(n.new_chunks, 0) AS new_chunks, coalesce(n.new_bytes, 0)::BIGINT AS new_bytes,
       round(CASE WHEN coalesce(a.chunks, 0) = 0 THEN 0 ELSE (a.chunks - coalesce(n.new_chunks, 0)) * 100.0::DOUBLE / a.chunks END, 6)::DOUBLE AS hit_rate
FROM contents c LEFT JOIN (SELECT content_id, count(*) AS chunks, sum(len) AS size FROM recipes GROUP BY content_id) a USING (content_id)
LEFT JOIN (SELECT content_id, count(*) AS new_chunks, sum(len) AS new_bytes FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ord, seq) AS k FROM recipes) WHERE k = 1 GROUP BY content_id) n USING (content_id)""",
    "roundtrip_sha": "SELECT content_id, true AS ok, strlen(text)::BIGINT AS size FROM contents WHERE text <> ''",
    "idle_sessions": """
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS events
FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run
      FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 600000000 THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
GROUP BY user_id, run""",
    "activity_sessions": """
SELECT min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS events
FROM (SELECT ts, sum(opens) OVER (ORDER BY ts, event_id) AS run
      FROM (SELECT ts, event_id, CASE WHEN lag(ts) OVER (ORDER BY ts, event_id) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id)) >= 600000000 THEN 1 ELSE 0 END AS opens FROM events))
GROUP BY run""",
    "events_tumbling": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}

def _doublings(sql: str) -> str:
    """The rolling hash of 64 bytes in six steps: after each, ``h`` covers twice as many bytes."""
    for w in (1, 2, 4, 8, 16, 32):
        sql = f"SELECT content_id, n, i, v, (h + coalesce(lag(h, {w}) OVER (PARTITION BY content_id ORDER BY i), 0) * {1 << w}) % {1 << 64} AS h FROM ({sql})"
    return sql


#: Blocks of the distinct texts: (content_id, ord, start, len, seq, chunk_id). The hash covers 64 bytes of the whole text, but
#: the first 63 places after a block's minimum see only the bytes from there on: what came before is taken off by its shift.
_CHUNKS = f"""
WITH RECURSIVE gear(b, v) AS MATERIALIZED (VALUES {", ".join(f"({b}, {int(v)}::HUGEINT)" for b, v in enumerate(kernels.GEAR))}),
raw AS MATERIALIZED (
  SELECT sha256(text) AS content_id, min(doc_id) AS ord, hex(encode(any_value(text))) AS x, strlen(any_value(text)) AS n
  FROM documents WHERE text IS NOT NULL GROUP BY 1
), byt AS MATERIALIZED (
  SELECT content_id, n, i, v, v AS h
  FROM (SELECT content_id, n, i, ('0x' || substr(x, 2 * i + 1, 2))::INT AS b FROM (SELECT content_id, n, x, unnest(range(n)) AS i FROM raw WHERE n > 4096)) JOIN gear USING (b)
), roll AS MATERIALIZED (
  {_doublings("SELECT content_id, n, i, v, h FROM byt")}
), low AS MATERIALIZED (
  SELECT content_id, i, h FROM roll WHERE h < {1 << 52}
), c(content_id, n, s, e) AS (
  SELECT content_id, n, 0::BIGINT, 0::BIGINT FROM raw WHERE n > 4096
  UNION ALL
  SELECT c.content_id, c.n, c.e, c.e + coalesce(
    CASE WHEN c.n - c.e <= 4096 THEN c.n - c.e END,
    (SELECT min(k.i) - c.e + 1 FROM roll k JOIN roll p USING (content_id) WHERE k.content_id = c.content_id AND p.i = c.e + 4095 AND k.i >= c.e + 4096 AND k.i < least(c.e + 4096 + 63, c.n)
       AND (k.h - (p.h * (1::HUGEINT << (k.i - p.i)::INT)) % {1 << 64} + {1 << 64}) % {1 << 64} < {1 << 48}),
    (SELECT min(k.i) - c.e + 1 FROM low k WHERE k.content_id = c.content_id AND k.i >= c.e + 4096 + 63 AND k.i < least(c.e + 16384, c.n) AND k.h < {1 << 48}),
    (SELECT min(k.i) - c.e + 1 FROM low k WHERE k.content_id = c.content_id AND k.i >= c.e + 16384 AND k.i < least(c.e + 65536, c.n)),
    least(c.n - c.e, 65536))
  FROM c WHERE c.e < c.n
), pieces AS (
  SELECT content_id, s AS start, e - s AS len FROM c WHERE e > 0
  UNION ALL SELECT content_id, 0, n FROM raw WHERE n BETWEEN 1 AND 4096
), chunks AS MATERIALIZED (
  SELECT content_id, ord, start, len, row_number() OVER (PARTITION BY content_id ORDER BY start) - 1 AS seq,
         sha256(unhex(substr(x, 2 * start + 1, 2 * len))) AS chunk_id
  FROM pieces JOIN raw USING (content_id)
)
"""

ORACLE_SQL: dict[str, str] = {name: _TABLES + body for name, body in _BODIES.items()}
ORACLE_SQL["chunk_documents"] = _CHUNKS + "SELECT content_id, seq::INT AS seq, chunk_id, start, len FROM chunks"
ORACLE_SQL["chunk_dedup"] = _CHUNKS + """, firsts AS (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ord, seq) AS k FROM chunks
), sums AS (
  SELECT content_id, count(*) AS chunks, sum(len)::BIGINT AS size, count(*) FILTER (k = 1) AS new_chunks, coalesce(sum(len) FILTER (k = 1), 0)::BIGINT AS new_bytes
  FROM firsts GROUP BY content_id
)
SELECT content_id, coalesce(chunks, 0) AS chunks, coalesce(size, 0) AS size, coalesce(new_chunks, 0) AS new_chunks, coalesce(new_bytes, 0) AS new_bytes,
       CASE WHEN chunks > 0 THEN round((chunks - new_chunks) * 100.0::DOUBLE / chunks, 6) ELSE 0.0::DOUBLE END AS hit_rate
FROM raw LEFT JOIN sums USING (content_id)"""

"""Independent SQL for the registered queries, over the given tables.

``VIEWS`` are the SQL twins of ``sources/views.py`` and of the shared
intermediate results; ``ORACLES`` maps a query name to a body over them. The
WITH clause of each statement holds just the views its body needs.
"""

from __future__ import annotations

import re

GENRES = (
    "['Action','Adventure','Animation','Children''s','Comedy','Crime','Documentary','Drama','Fantasy',"
    "'Film-Noir','Horror','Musical','Mystery','Romance','Sci-Fi','Thriller','War','Western']"
)

VIEWS = {
    "ratings": """
        SELECT CAST(o_custkey AS BIGINT) AS userId, CAST(l_partkey AS BIGINT) AS movieId,
               CAST(floor((l_quantity - 1) / 10) + 1 AS INTEGER) AS rating,
               CAST(epoch(o_orderdate) AS BIGINT) AS "timestamp"
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "genre_bits": f"""
        SELECT genre, CAST(row_number() OVER () - 1 AS INTEGER) AS bit
        FROM (SELECT unnest({GENRES}) AS genre)""",
    "bits": "SELECT CAST(range AS INTEGER) AS bit FROM range(18)",
    "movies": f"""
        SELECT CAST(p_partkey AS BIGINT) AS movieId,
               array_to_string(list_transform(string_split(p_name, ' '),
                   lambda w: upper(w[1]) || lower(w[2:])), ' ')
               || CASE WHEN p_partkey % 4 = 0 THEN ', The' ELSE '' END
               || CASE WHEN p_partkey % 11 = 0 THEN ' (Alt Name)' ELSE '' END
               || CASE WHEN p_partkey % 97 = 0 THEN '' ELSE ' (' || (1930 + p_partkey % 71) || ')' END AS title,
               CASE WHEN p_partkey % 18 = p_size % 18 THEN {GENRES}[p_partkey % 18 + 1]
                    ELSE {GENRES}[p_partkey % 18 + 1] || '|' || {GENRES}[p_size % 18 + 1] END AS genres
        FROM part""",
    "movie_genres": """
        SELECT movieId, unnest(string_split(genres, '|')) AS genre FROM movies""",
    "movie_masks": """
        SELECT movieId, CAST(sum(1 << bit) AS INTEGER) AS mask
        FROM (SELECT DISTINCT movieId, genre FROM movie_genres) JOIN genre_bits USING (genre) GROUP BY movieId""",
    "movie_years": r"""
        SELECT movieId, CAST(nullif(regexp_extract(title, '\((\d{4})\)\s*$', 1), '') AS INTEGER) AS year
        FROM movies""",
    "users": """
        SELECT CAST(c_custkey AS BIGINT) AS userId, CASE WHEN c_custkey % 2 = 1 THEN 'F' ELSE 'M' END AS gender,
               [1, 18, 25, 35, 45, 50, 56][c_nationkey % 7 + 1] AS age,
               CAST(c_custkey % 21 AS INTEGER) AS occupation, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS zip
        FROM customer""",
    "item_factors": """
        SELECT CAST(vec_id AS BIGINT) AS id,
               list_transform(embedding[1:10], lambda x: abs(CAST(x AS DOUBLE))) AS features FROM embeddings""",
    "user_factors": """
        SELECT CAST(vec_id AS BIGINT) AS id,
               list_transform(embedding[11:20], lambda x: abs(CAST(x AS DOUBLE))) AS features FROM embeddings""",
    "posters": "SELECT CAST(page_id AS BIGINT) AS movieId, url FROM pages",
    "external": """
        SELECT CAST(p_partkey + 100000 AS BIGINT) AS ext_id,
               CASE WHEN p_name LIKE 'hot %' AND p_partkey % 11 = 0 THEN 'ALT NAME' ELSE
                   CASE WHEN p_partkey % 4 = 0 THEN 'The ' ELSE '' END
                   || array_to_string(list_transform(string_split(p_name, ' '),
                       lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS name,
               CAST(1930 + p_partkey % 71 + [0, -1, 1, NULL][p_partkey % 4 + 1] AS INTEGER) AS year,
               CASE WHEN p_size % 5 = 0 OR (p_name LIKE 'hot %' AND p_partkey % 11 <> 0) THEN NULL
                    ELSE '/' || p_partkey || '.jpg' END AS poster_path
        FROM part""",
    "links": """
        SELECT CAST(p_partkey AS BIGINT) AS movieId,
               CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE CAST(p_partkey + 100000 AS VARCHAR) END AS tmdbId
        FROM part""",
    "customers": "SELECT CAST(c_custkey AS BIGINT) AS userId FROM customer",
    "order_ids": "SELECT CAST(o_orderkey AS BIGINT) AS movieId FROM orders",
    "counts": """
        SELECT movieId, count(*) AS cnt, sum(rating) AS total FROM ratings GROUP BY movieId""",
    "popular": """
        SELECT row_number() OVER (ORDER BY cnt DESC, movieId) AS rank, movieId, cnt, total
        FROM counts ORDER BY cnt DESC, movieId LIMIT 10""",
    "popular_list": """
        SELECT CAST(rank AS INTEGER) AS rank, movieId, title, genres FROM popular JOIN movies USING (movieId)""",
    # --- titles
    "names": r"""
        SELECT movieId, years, unnest(names) AS raw_name, generate_subscripts(names, 1) AS raw_pos FROM (
            SELECT movieId,
                   CASE WHEN year IS NULL THEN [NULL] ELSE [year, year - 1, year + 1, NULL] END AS years,
                   list_prepend(trim(regexp_replace(base, '\s*\([^()]+\)', '', 'g')),
                                regexp_extract_all(base, '\(([^()]+)\)', 1)) AS names
            FROM (SELECT movieId, year, trim(regexp_replace(title, '\s*\(\d{4}\)\s*$', '')) AS base
                  FROM movies JOIN movie_years USING (movieId)))""",
    "search_names": r"""
        SELECT movieId, years, name, row_number() OVER (PARTITION BY movieId ORDER BY min(raw_pos)) - 1 AS pos
        FROM (
            SELECT movieId, years, raw_pos,
                   CASE WHEN regexp_matches(n, '^(.*), (The|A|An|La|Le|Les|L''|Il|Das|Der|Die|El|Los|Las)$')
                        THEN replace(regexp_replace(n, '^(.*), (The|A|An|La|Le|Les|L''|Il|Das|Der|Die|El|Los|Las)$',
                                                    '\2 \1'), 'L'' ', 'L''')
                        ELSE n END AS name
            FROM (SELECT *, regexp_replace(trim(raw_name), '(?i)^a\.k\.a\.\s*', '') AS n FROM names))
        WHERE name <> '' GROUP BY movieId, years, name""",
    "matched": """
        SELECT movieId, ext_id, poster_path, year_pos, name_pos FROM (
            SELECT t.movieId, e.ext_id, e.poster_path, t.year_pos, t.name_pos,
                   row_number() OVER (PARTITION BY t.movieId ORDER BY t.year_pos, t.name_pos, e.ext_id) AS rn
            FROM (SELECT movieId, name, pos AS name_pos, unnest(years) AS try_year,
                         generate_subscripts(years, 1) - 1 AS year_pos FROM search_names) t
            JOIN external e ON lower(e.name) = lower(t.name) AND (t.try_year IS NULL OR e.year = t.try_year)
            WHERE e.poster_path IS NOT NULL)
        WHERE rn = 1""",
    "resolved": """
        SELECT m.movieId, m.title,
               CASE WHEN e.poster_path IS NOT NULL THEN 'id' WHEN x.poster_path IS NOT NULL THEN 'title' END AS matched_by,
               'https://images.example.org/t/p/w500' || coalesce(e.poster_path, x.poster_path) AS url
        FROM movies m
        LEFT JOIN links l ON l.movieId = m.movieId AND l.tmdbId <> ''
        LEFT JOIN external e ON e.ext_id = CAST(nullif(l.tmdbId, '') AS BIGINT) AND e.poster_path IS NOT NULL
        LEFT JOIN matched x ON x.movieId = m.movieId""",
    "upserted": """
        SELECT movieId, url FROM posters
        UNION ALL
        SELECT movieId, replace(url, '/w500/', '/w342/') FROM resolved
        WHERE url IS NOT NULL AND movieId NOT IN (SELECT movieId FROM posters)""",
    "shelf": """
        SELECT 1 AS list_no, rank AS pos, movieId, title FROM popular_list
        UNION ALL SELECT 2, movieId, movieId, title FROM movies""",
    "shelf_once": """
        SELECT movieId, list_no, pos, title FROM (
            SELECT *, row_number() OVER (PARTITION BY movieId ORDER BY list_no, pos) AS rn FROM shelf) WHERE rn = 1""",
    # --- given vectors
    "all_scores": """
        SELECT u.id AS userId, i.id AS movieId, list_dot_product(u.features, i.features) AS score
        FROM user_factors u, item_factors i""",
    "vector_top_all": """
        SELECT userId, movieId, score, rank FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY userId ORDER BY score DESC, movieId) AS INTEGER) AS rank
            FROM all_scores) WHERE rank <= 10""",
    "vector_users": "SELECT id AS userId FROM user_factors WHERE id IN (SELECT userId FROM ratings)",
    "vector_picks": """
        SELECT t.* FROM vector_top_all t SEMI JOIN vector_users USING (userId)
        ANTI JOIN ratings USING (userId, movieId)""",
    # --- trained model
    "split": """
        SELECT *, CAST('0x' || substr(md5(userId || ':' || movieId), 1, 7) AS BIGINT) % 10 AS bucket FROM ratings""",
    "train": "SELECT * FROM split WHERE bucket < 8",
    "test": "SELECT * FROM split WHERE bucket >= 8",
    "scored_test": """
        SELECT * FROM test WHERE userId IN (SELECT userId FROM train) AND movieId IN (SELECT movieId FROM train)""",
    # --- quality of lists
    "test_lists": """
        SELECT userId, movieId, row_number() OVER (PARTITION BY userId ORDER BY score DESC, movieId) AS rank
        FROM vector_top_all SEMI JOIN vector_users USING (userId) ANTI JOIN train USING (userId, movieId)""",
    "list_metrics": """
        WITH gains AS (
            SELECT f.relevant_from, t.userId, t.movieId, pow(2.0::DOUBLE, max(t.rating)) - 1 AS gain
            FROM test t JOIN (SELECT unnest([3, 4, 5]) AS relevant_from) f ON t.rating >= f.relevant_from
            GROUP BY f.relevant_from, t.userId, t.movieId),
        ideal AS (
            SELECT relevant_from, userId, count(*) AS n_relevant, sum(CASE WHEN place <= 10 THEN gain / log2(place + 1) END) AS ideal
            FROM (SELECT *, row_number() OVER (PARTITION BY relevant_from, userId ORDER BY gain DESC, movieId) AS place FROM gains)
            GROUP BY relevant_from, userId),
        hits AS (
            SELECT g.relevant_from, g.userId, count(*) AS n_hits, sum(g.gain / log2(l.rank + 1)) AS dcg
            FROM gains g JOIN test_lists l ON l.userId = g.userId AND l.movieId = g.movieId AND l.rank <= 10
            GROUP BY g.relevant_from, g.userId)
        SELECT i.relevant_from, i.userId, i.n_relevant, coalesce(h.n_hits, 0) AS n_hits, coalesce(h.n_hits, 0) / 10.0::DOUBLE AS precision,
               coalesce(h.n_hits, 0)::DOUBLE / i.n_relevant AS recall, coalesce(h.dcg, 0) / i.ideal AS ndcg
        FROM ideal i LEFT JOIN hits h ON h.relevant_from = i.relevant_from AND h.userId = i.userId""",
    "film_bits": """
        SELECT movieId, log2((SELECT count(DISTINCT userId) FROM ratings)::DOUBLE / count(DISTINCT userId)) AS bits
        FROM ratings GROUP BY movieId""",
    "event_counts": """
        SELECT userId, movieId, CAST(sum(w) AS DOUBLE) AS rating FROM (
            SELECT CAST(user_id AS BIGINT) AS userId, CAST(json_extract_string(props, '$.k') AS BIGINT) AS movieId,
                   CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 END AS w FROM events)
        WHERE w IS NOT NULL AND userId IS NOT NULL AND movieId IS NOT NULL GROUP BY userId, movieId""",
    "event_split": """
        SELECT *, CAST('0x' || substr(md5(userId || ':' || movieId), 1, 7) AS BIGINT) % 10 AS bucket FROM event_counts""",
    # --- films
    "film_table": """
        SELECT c.movieId, m.title, coalesce(y.year, 0) AS year, k.mask, CAST(c.cnt AS INTEGER) AS cnt,
               CAST(round_even(CAST(10.0 AS DOUBLE) * c.total / c.cnt, 0) AS INTEGER) AS mean10,
               list_transform(f.features, lambda x: CAST(round_even(x * 1000, 0) AS INTEGER)) AS q
        FROM counts c JOIN item_factors f ON f.id = c.movieId JOIN movies m ON m.movieId = c.movieId
        JOIN movie_years y ON y.movieId = c.movieId JOIN movie_masks k ON k.movieId = c.movieId
        WHERE c.cnt >= 20""",
    "film_means": """
        SELECT *, CAST(mean10 AS DOUBLE) / 10 AS mean,
               list_transform(q, lambda x: CAST(x AS DOUBLE) / 1000) AS features FROM film_table""",
    "films": """
        SELECT *, (mean * cnt + (SELECT sum(mean * cnt) / sum(cnt) FROM film_means) * 50) / (cnt + 50) AS score
        FROM film_means""",
    "eras": """
        SELECT * FROM (VALUES ('any', 0, 3000), ('classic', 0, 1969), ('7080', 1970, 1989), ('90s', 1990, 3000))
        AS t(era, year_from, year_to)""",
    "reaches": """
        SELECT * FROM (VALUES ('popular', 40, 2147483647), ('balanced', 30, 2147483647), ('gems', 20, 35))
        AS t(reach, cnt_min, cnt_max)""",
    "moods": """
        SELECT mood, unnest(names) AS genre, generate_subscripts(names, 1) AS pos FROM (VALUES
            ('feel-good', ['Comedy', 'Romance', 'Musical', 'Animation', 'Children''s']),
            ('edge', ['Thriller', 'Action', 'Crime']), ('mind', ['Sci-Fi', 'Mystery', 'Thriller']),
            ('emotional', ['Drama', 'Romance', 'War']), ('scare', ['Horror']),
            ('adventure', ['Adventure', 'Fantasy', 'Western'])) AS t(mood, names)""",
    "mood_masks": """
        SELECT mood, CAST(sum(1 << bit) AS INTEGER) AS mask, string_agg(genre, '|' ORDER BY pos) AS genres
        FROM moods JOIN genre_bits USING (genre) GROUP BY mood""",
    # --- requests
    "requests": """
        SELECT CAST(c_custkey AS BIGINT) AS reqId,
               ['feel-good', 'edge', 'mind', 'emotional', 'scare', 'adventure', NULL][c_custkey % 7 + 1] AS mood,
               ['any', 'classic', '7080', '90s', 'lost'][c_nationkey % 5 + 1] AS era,
               ['popular', 'balanced', 'gems', 'mixed'][c_custkey % 4 + 1] AS reach
        FROM customer""",
    "prepared": """
        SELECT reqId, coalesce(mask, 262143) AS wanted,
               CASE WHEN era = 'lost' THEN 'any' ELSE era END AS era,
               CASE WHEN reach = 'mixed' THEN 'balanced' ELSE reach END AS reach
        FROM requests LEFT JOIN mood_masks USING (mood)""",
    "reactions": """
        SELECT userId AS reqId, movieId, rating FROM (
            SELECT *, row_number() OVER (PARTITION BY userId, movieId ORDER BY "timestamp" DESC, rating DESC) AS rn
            FROM ratings) WHERE rn = 1""",
    "rated": """
        SELECT reqId, movieId, rating AS r, mask, features, q
        FROM reactions JOIN films USING (movieId) WHERE rating IN (2, 4, 5)""",
    "tiers": "SELECT * FROM (VALUES (0, 40), (1, 35), (2, 25)) AS t(tier, least)",
    "choices": "SELECT DISTINCT wanted, era FROM prepared",
    "anchor_candidates": """
        SELECT c.wanted, c.era, t.tier, f.movieId, f.features, f.q,
               row_number() OVER (PARTITION BY c.wanted, c.era, t.tier
                                  ORDER BY f.score DESC, f.cnt DESC, f.movieId) AS pos,
               count(*) OVER (PARTITION BY c.wanted, c.era, t.tier) AS n
        FROM choices c JOIN eras e USING (era)
        JOIN films f ON (f.mask & c.wanted) <> 0 AND f.year BETWEEN e.year_from AND e.year_to
        JOIN tiers t ON f.cnt >= t.least""",
    "good_tiers": "SELECT wanted, era, min(tier) AS tier FROM anchor_candidates WHERE n >= 8 GROUP BY wanted, era",
    "anchors": """
        SELECT wanted, era, tier, pos, movieId, features, q
        FROM anchor_candidates JOIN good_tiers USING (wanted, era, tier) WHERE pos <= 20
        UNION ALL
        SELECT c.wanted, c.era, NULL, d.pos, d.movieId, d.features, d.q
        FROM choices c ANTI JOIN good_tiers USING (wanted, era),
             (SELECT movieId, features, q, row_number() OVER (ORDER BY cnt DESC, movieId) AS pos
              FROM films ORDER BY cnt DESC, movieId LIMIT 20) d""",
    "n_rated": "SELECT reqId, count(*) AS n_rated FROM rated GROUP BY reqId",
    "fold_rows": """
        SELECT p.reqId, 'anchor' AS source, a.movieId, CAST(5 AS DOUBLE) AS r,
               CAST(0.35 AS DOUBLE) * 5 / (5 + coalesce(n.n_rated, 0)) AS w, a.features
        FROM prepared p JOIN anchors a USING (wanted, era) LEFT JOIN n_rated n USING (reqId)
        UNION ALL
        SELECT reqId, 'rated', movieId, CAST(r AS DOUBLE), CAST(1 AS DOUBLE), features FROM rated""",
    "places": "SELECT CAST(range AS INTEGER) AS i FROM range(10)",
    "weights": """
        SELECT p.reqId, p.wanted, p.era, CAST(0.35 AS DOUBLE) * 5 / (5 + coalesce(n.n_rated, 0)) AS w
        FROM prepared p LEFT JOIN n_rated n USING (reqId)""",
    "affinities": """
        SELECT p.reqId, b.bit,
               CASE WHEN (p.wanted & (1 << b.bit)) <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
               + coalesce(a.gain, 0) AS affinity
        FROM (SELECT reqId, wanted FROM prepared) p CROSS JOIN bits b
        LEFT JOIN (SELECT r.reqId, b.bit, sum((r.r - 3) / 2.0::DOUBLE) AS gain
                   FROM (SELECT reqId, r, mask FROM rated) r
                   JOIN bits b ON (r.mask & (1 << b.bit)) <> 0 GROUP BY r.reqId, b.bit) a
               ON a.reqId = p.reqId AND a.bit = b.bit""",
    "mask_fits": """
        SELECT s.reqId, k.mask, (max(s.scaled) + avg(s.scaled)) / 2 AS fit
        FROM (SELECT reqId, bit,
                     affinity / greatest(1.0::DOUBLE, max(affinity) OVER (PARTITION BY reqId)) AS scaled
              FROM affinities) s
        JOIN (SELECT DISTINCT mask FROM films) k ON (k.mask & (1 << s.bit)) <> 0
        GROUP BY s.reqId, k.mask""",
    "candidates": """
        SELECT p.reqId, f.movieId, f.mask, f.cnt, f.features
        FROM prepared p JOIN eras e USING (era) JOIN reaches h USING (reach)
        JOIN films f ON (f.mask & p.wanted) <> 0 AND f.year BETWEEN e.year_from AND e.year_to
                    AND f.cnt BETWEEN h.cnt_min AND h.cnt_max""",
}

# checks of trained models compare counts and properties, as values vary in the last digits
ORACLES = {
    "popular_movies": """
        SELECT movieId, title, cnt AS rating_count, round(total / cnt, 6) AS average_rating
        FROM popular JOIN movies USING (movieId)""",
    "top10_most_rated": "SELECT movieId, title, cnt AS rating_count FROM popular JOIN movies USING (movieId)",
    "movie_stats": """
        SELECT movieId, cnt AS rating_count, round(total / cnt, 6) AS average_rating, title, genres
        FROM counts JOIN movies USING (movieId)""",
    "top_rated_min_support": """
        SELECT movieId, title, cnt AS rating_count, round(total / cnt, 6) AS average_rating
        FROM counts JOIN movies USING (movieId) WHERE cnt >= 40 ORDER BY total / cnt DESC, movieId LIMIT 10""",
    "popular_fallback": "SELECT * FROM popular_list",
    "table_shapes": """
        SELECT 'ratings' AS table_name, count(*) AS n_rows, 4 AS n_columns FROM ratings
        UNION ALL SELECT 'movies', count(*), 3 FROM movies UNION ALL SELECT 'users', count(*), 5 FROM users""",
    "null_audit": """
        SELECT table_name, column_name, CAST(n_null AS BIGINT) AS n_null FROM (
        SELECT 'ratings' AS table_name, unnest(['userId', 'movieId', 'rating', 'timestamp']) AS column_name,
               unnest([count(*) - count(userId), count(*) - count(movieId), count(*) - count(rating),
                       count(*) - count("timestamp")]) AS n_null FROM ratings
        UNION ALL
        SELECT 'movies', unnest(['movieId', 'title', 'genres']),
               unnest([count(*) - count(movieId), count(*) - count(title), count(*) - count(genres)]) FROM movies
        UNION ALL
        SELECT 'users', unnest(['userId', 'gender', 'age', 'occupation', 'zip']),
               unnest([count(*) - count(userId), count(*) - count(gender), count(*) - count(age),
                       count(*) - count(occupation), count(*) - count(zip)]) FROM users
        UNION ALL
        SELECT 'posters', unnest(['movieId', 'title', 'genres', 'url']),
               unnest([count(*) - count(movieId), count(*) - count(title), count(*) - count(genres),
                       count(*) - count(url)]) FROM movies LEFT JOIN posters USING (movieId)
        UNION ALL
        SELECT 'links', unnest(['movieId', 'tmdbId']),
               unnest([count(*) - count(movieId), count(*) - count(tmdbId)]) FROM links)""",
    "duplicate_count": """
        SELECT 'all columns' AS scope,
               (SELECT count(*) FROM ratings) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ratings)) AS n_duplicates
        UNION ALL
        SELECT 'user and movie',
               (SELECT count(*) FROM ratings) - (SELECT count(*) FROM (SELECT DISTINCT userId, movieId FROM ratings))""",
    "rating_histogram": "SELECT rating, count(*) AS n FROM ratings GROUP BY rating",
    "rating_distribution_pct": """
        SELECT rating, n, round(100 * n / t, 2) AS pct,
               round(100 * (sum(n) OVER (ORDER BY rating DESC)) / t, 2) AS pct_at_least,
               rank() OVER (ORDER BY n DESC, rating DESC) = 1 AS is_mode
        FROM (SELECT rating, count(*)::DOUBLE AS nn, count(*) AS n, (SELECT count(*)::DOUBLE FROM ratings) AS t
              FROM ratings GROUP BY rating)""",
    "rating_summary": """
        SELECT count(*) AS n_ratings, round(avg(rating), 6) AS mean_rating, min(rating) AS min_rating,
               max(rating) AS max_rating FROM ratings""",
    "matrix_sparsity": """
        SELECT n_ratings, n_users, n_movies,
               round((1 - n_ratings / (n_users::DOUBLE * n_movies)) * 100, 6) AS sparsity_pct
        FROM (SELECT count(*) AS n_ratings, count(DISTINCT userId) AS n_users,
                     (SELECT count(*) FROM movies) AS n_movies FROM ratings)""",
    "rating_time_range": """
        SELECT min("timestamp") AS first_epoch, max("timestamp") AS last_epoch,
               strftime(make_timestamp(min("timestamp") * 1000000), '%Y-%m-%d %H:%M:%S') AS first_at,
               strftime(make_timestamp(max("timestamp") * 1000000), '%Y-%m-%d %H:%M:%S') AS last_at
        FROM ratings""",
    "user_demographics": """
        SELECT userId, gender,
               CASE age WHEN 1 THEN 'Under 18' WHEN 18 THEN '18-24' WHEN 25 THEN '25-34' WHEN 35 THEN '35-44'
                        WHEN 45 THEN '45-49' WHEN 50 THEN '50-55' WHEN 56 THEN '56+' END AS age_group,
               ['other', 'academic/educator', 'artist', 'clerical/admin', 'college/grad student',
                'customer service', 'doctor/health care', 'executive/managerial', 'farmer', 'homemaker',
                'K-12 student', 'lawyer', 'programmer', 'retired', 'sales/marketing', 'scientist',
                'self-employed', 'technician/engineer', 'tradesman/craftsman', 'unemployed',
                'writer'][occupation + 1] AS occupation_name, zip
        FROM users""",
    "scan_dat_ratings": "SELECT * FROM ratings",
    "scan_dat_movies": "SELECT * FROM movies",
    "scan_dat_users": "SELECT * FROM users",
    "scan_csv_ratings": "SELECT * FROM ratings",
    "sink_csv_roundtrip": "SELECT * FROM movies",
    "sink_full_refresh": "SELECT count(*) AS n_users, count(DISTINCT zip) AS n_zip FROM users",
    "refresh_versions": """
        SELECT 'before' AS version, rating, count(*) AS n FROM ratings GROUP BY rating
        UNION ALL SELECT 'current', rating, count(*) FROM ratings WHERE rating = 5 GROUP BY rating""",
    "counts_while_writing": """
        SELECT table_name, column_name, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_null AS BIGINT) AS n_null FROM (
        SELECT count(*) AS n_rows, 'ratings' AS table_name, unnest(['userId', 'movieId', 'rating', 'timestamp']) AS column_name,
               unnest([count(*) - count(userId), count(*) - count(movieId), count(*) - count(rating),
                       count(*) - count("timestamp")]) AS n_null FROM ratings
        UNION ALL
        SELECT count(*), 'movies', unnest(['movieId', 'title', 'genres']),
               unnest([count(*) - count(movieId), count(*) - count(title), count(*) - count(genres)]) FROM movies
        UNION ALL
        SELECT count(*), 'users', unnest(['userId', 'gender', 'age', 'occupation', 'zip']),
               unnest([count(*) - count(userId), count(*) - count(gender), count(*) - count(age),
                       count(*) - count(occupation), count(*) - count(zip)]) FROM users
        UNION ALL
        SELECT count(*), 'posters', unnest(['movieId', 'title', 'genres', 'url']),
               unnest([count(*) - count(movieId), count(*) - count(title), count(*) - count(genres),
                       count(*) - count(url)]) FROM movies LEFT JOIN posters USING (movieId)
        UNION ALL
        SELECT count(*), 'links', unnest(['movieId', 'tmdbId']),
               unnest([count(*) - count(movieId), count(*) - count(tmdbId)]) FROM links)""",
    "links_nonblank": "SELECT * FROM links WHERE tmdbId <> ''",
    "json_map_explode": "SELECT * FROM posters",
    "ratings_checked": """
        SELECT userId, movieId, CASE WHEN kind NOT IN (1, 2) THEN rating END AS rating,
               CASE WHEN kind <> 0 THEN "timestamp" END AS "timestamp",
               CASE WHEN kind < 4 THEN userId || '::' || movieId || '::'
                   || CASE kind WHEN 1 THEN 'x' || rating WHEN 2 THEN '' ELSE CAST(rating AS VARCHAR) END
                   || CASE WHEN kind = 0 THEN '' ELSE '::' || "timestamp" END
                   || CASE WHEN kind = 3 THEN '::more' ELSE '' END END AS line,
               CASE WHEN kind IN (0, 3) THEN 'not 4 fields' WHEN kind = 1 THEN 'rating: ''x' || rating || ''' is no int'
                   WHEN kind = 2 THEN 'rating is missing' END AS reason
        FROM (SELECT *, movieId % 9 AS kind FROM ratings)""",
    "movies_checked": """
        SELECT CASE WHEN movieId % 5 <> 0 THEN movieId END AS movieId,
               CASE WHEN movieId % 7 <> 0 THEN '"' || title || '", cut' END AS title, genres,
               CASE WHEN movieId % 5 = 0 OR movieId % 7 = 0 THEN
                   CASE WHEN movieId % 5 = 0 THEN 'no. ' ELSE '' END || movieId || ','
                   || CASE WHEN movieId % 7 = 0 THEN '' ELSE '"' || '""' || title || '"", cut"' END || ',' || genres END AS line,
               CASE WHEN movieId % 5 = 0 THEN 'movieId: ''no. ' || movieId || ''' is no bigint'
                    WHEN movieId % 7 = 0 THEN 'title is missing' END AS reason
        FROM movies""",
    "json_map_checked": """
        SELECT CASE WHEN movieId % 7 <> 0 AND movieId % 5 <> 0 THEN movieId END AS movieId,
               CASE WHEN movieId % 7 <> 0 THEN url END AS url,
               CASE WHEN movieId % 7 = 0 THEN '[' || movieId
                    WHEN movieId % 5 = 0 THEN '{"film ' || movieId || '":"' || url || '"}' END AS line,
               CASE WHEN movieId % 7 = 0 THEN 'not a JSON object'
                    WHEN movieId % 5 = 0 THEN 'key ''film ' || movieId || ''' is no film id' END AS reason
        FROM posters""",
    "rejected_ids": r"""
        SELECT raw_id, reason FROM (
            SELECT raw_id, CASE WHEN trim(raw_id) = '' THEN 'blank'
                   WHEN NOT regexp_full_match(trim(raw_id), '\d+') THEN 'not a number'
                   WHEN length(trim(raw_id)) > 7 THEN 'too long' END AS reason
            FROM (SELECT '  ' || c_custkey || ' ' AS raw_id FROM customer
                  UNION ALL SELECT c_name FROM customer
                  UNION ALL SELECT '12345' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') FROM customer
                  UNION ALL SELECT c_custkey || '.5' FROM customer))
        WHERE reason IS NOT NULL""",
    "requests_table": """
        SELECT reqId, mood, coalesce(genres, '') AS genres, era, reach
        FROM requests LEFT JOIN mood_masks USING (mood)""",
    "lookup_movies_by_ids": "SELECT * FROM movies WHERE movieId IN (SELECT movieId FROM posters)",
    "export_films": """
        SELECT movieId, title, year, mask, cnt, mean10, array_to_string(q, ',') AS q FROM film_table""",
    "decode_films": """
        SELECT movieId, title, year, mask, cnt, mean, genres,
        """ + ", ".join(f"round(features[{i + 1}], 6) AS f{i}" for i in range(10)) + """
        FROM film_means JOIN (
            SELECT movieId, string_agg(genre, '|' ORDER BY bit) AS genres
            FROM (SELECT DISTINCT movieId, genre FROM movie_genres) JOIN genre_bits USING (genre) GROUP BY movieId
        ) USING (movieId)""",
    "export_user_picks": """
        SELECT u.userId, CASE WHEN p.rank IS NOT NULL THEN
                   CAST(row_number() OVER (PARTITION BY u.userId ORDER BY p.rank) - 1 AS INTEGER) END AS pos,
               p.movieId, round_even(p.score, 2) AS score
        FROM vector_users u LEFT JOIN vector_picks p USING (userId)""",
    "serve_precomputed": """
        SELECT userId, 'personalized' AS type,
               CAST(row_number() OVER (PARTITION BY userId ORDER BY rank) AS INTEGER) AS rank, movieId,
               coalesce(title, 'Movie ' || movieId) AS title, coalesce(genres, '') AS genres,
               round_even(score, 2) AS predictedRating
        FROM customers SEMI JOIN vector_users USING (userId)
        JOIN vector_picks USING (userId) LEFT JOIN movies USING (movieId)
        UNION ALL
        SELECT userId, 'popular', rank, movieId, title, genres, NULL
        FROM customers ANTI JOIN vector_users USING (userId), popular_list""",
    "als_input": "SELECT userId, movieId, rating FROM ratings",
    "user_history": """
        SELECT userId, movieId, rating FROM ratings
        WHERE userId IN (SELECT CAST(user_id AS BIGINT) FROM events)""",
    "distinct_users": "SELECT DISTINCT userId FROM ratings",
    "rated_sets": "SELECT DISTINCT userId, movieId FROM ratings",
    "known_user_flag": "SELECT userId, userId IN (SELECT id FROM user_factors) AS known FROM customers",
    "validate_ids": r"""
        SELECT raw_id, is_valid, CASE WHEN is_valid THEN CAST(trim(raw_id) AS BIGINT) END AS userId
        FROM (SELECT raw_id, regexp_matches(trim(raw_id), '^\d{1,7}$') AS is_valid FROM (
              SELECT '  ' || c_custkey || ' ' AS raw_id FROM customer
              UNION ALL SELECT c_name FROM customer
              UNION ALL SELECT '12345' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') FROM customer
              UNION ALL SELECT c_custkey || '.5' FROM customer))""",
    "genres_exploded": "SELECT movieId, genre FROM movie_genres",
    "genre_mask": """
        SELECT movieId, mask, (SELECT string_agg(genre, '|' ORDER BY bit) FROM genre_bits
                               WHERE (mask & (1 << bit)) <> 0) AS decoded FROM movie_masks""",
    "mood_genres": "SELECT reqId, mood, genre FROM requests JOIN moods USING (mood)",
    "title_year": "SELECT movieId, year, coalesce(year, 0) AS year_or_zero FROM movie_years",
    "title_display": r"""
        SELECT movieId, regexp_replace(trim(regexp_replace(regexp_replace(title, '^(.*)\s+\((\d{4})\)\s*$', '\1'),
                   '(\s+\([^()]{3,}\))+$', '')),
                   '^(.*), (The|A|An|La|Le|Les|Il|Das|Der|Die|El)$', '\2 \1') AS display,
               CAST(nullif(regexp_extract(title, '^(.*)\s+\((\d{4})\)\s*$', 2), '') AS INTEGER) AS year
        FROM movies""",
    "title_variants": "SELECT movieId, CAST(pos AS INTEGER) AS pos, name FROM search_names",
    "normalise_movies": r"""
        SELECT movieId AS id, title AS rawTitle,
               regexp_replace(trim(regexp_replace(regexp_replace(title, '^(.*)\s+\((\d{4})\)\s*$', '\1'),
                   '(\s+\([^()]{3,}\))+$', '')),
                   '^(.*), (The|A|An|La|Le|Les|Il|Das|Der|Die|El)$', '\2 \1') AS title,
               CAST(nullif(regexp_extract(title, '^(.*)\s+\((\d{4})\)\s*$', 2), '') AS INTEGER) AS year,
               genres, CAST(NULL AS DOUBLE) AS predicted, nullif(url, '') AS posterUrl
        FROM movies LEFT JOIN posters USING (movieId)""",
    "quantise_features": """
        SELECT id, CAST(generate_subscripts(features, 1) - 1 AS INTEGER) AS k,
               CAST(round_even(unnest(features) * 1000, 0) AS INTEGER) AS q FROM item_factors""",
    "clamp_score": """
        SELECT o_orderkey AS id, round(s, 6) AS score, round_even(s, 2) AS stored,
               floor(s * 100 + 0.5) / 100 AS reported, round(least(5.0::DOUBLE, s), 1) AS shown
        FROM (SELECT o_orderkey, o_totalprice / 90000 AS s FROM orders)""",
    "films_by_era": "SELECT era, movieId, year FROM films JOIN eras ON year BETWEEN year_from AND year_to",
    "films_by_reach": "SELECT reach, movieId, cnt FROM films JOIN reaches ON cnt BETWEEN cnt_min AND cnt_max",
    "films_any_genre": """
        SELECT mood, movieId, f.mask FROM films f JOIN mood_masks m ON (f.mask & m.mask) <> 0""",
    "enrich_left": "SELECT movieId, title, genres FROM order_ids LEFT JOIN movies USING (movieId)",
    "enrich_with_default": """
        SELECT movieId, coalesce(title, 'Movie ' || movieId) AS title, coalesce(genres, '') AS genres
        FROM order_ids LEFT JOIN movies USING (movieId)""",
    "poster_coalesce": """
        SELECT m.movieId, coalesce(nullif(l.tmdbId, ''), nullif(p.url, '')) AS url
        FROM movies m LEFT JOIN links l USING (movieId) LEFT JOIN posters p USING (movieId)""",
    "title_match": """
        SELECT movieId, ext_id, poster_path, CAST(year_pos AS INTEGER) AS year_pos,
               CAST(name_pos AS INTEGER) AS name_pos FROM matched""",
    "poster_resolve": "SELECT * FROM resolved",
    "poster_upsert": "SELECT * FROM upserted",
    "poster_upsert_slots": "SELECT * FROM upserted",
    "poster_missing": "SELECT movieId, title FROM movies ANTI JOIN upserted USING (movieId)",
    "match_coverage": """
        SELECT n_posters, n_movies, round(100.0::DOUBLE * n_posters / n_movies, 1) AS coverage_pct
        FROM (SELECT (SELECT count(*) FROM upserted) AS n_posters, (SELECT count(*) FROM movies) AS n_movies)""",
    "dedup_keep_first": "SELECT movieId, list_no, pos, title FROM shelf_once",
    "poster_first": """
        WITH flagged AS (SELECT *, movieId IN (SELECT movieId FROM posters) AS has_poster FROM shelf_once)
        SELECT 'wall' AS view, movieId, title, has_poster FROM (
            SELECT * FROM flagged ORDER BY has_poster DESC, list_no, pos LIMIT 96)
        UNION ALL
        SELECT 'ring', movieId, title, has_poster FROM (
            SELECT * FROM flagged WHERE has_poster OR (SELECT count(*) FROM flagged WHERE has_poster) < 20
            ORDER BY list_no, pos LIMIT 20)""",
    "score_pairs": """
        SELECT r.userId, r.movieId, round(list_dot_product(u.features, i.features), 6) AS score
        FROM (SELECT DISTINCT userId, movieId FROM ratings) r
        JOIN user_factors u ON u.id = r.userId JOIN item_factors i ON i.id = r.movieId""",
    "topk_per_user": "SELECT userId, rank, movieId, round(score, 6) AS score FROM vector_top_all",
    "exclude_rated": "SELECT userId, rank, movieId, round(score, 6) AS score FROM vector_picks",
    "exclude_rated_clustered": "SELECT userId, rank, movieId, round(score, 6) AS score FROM vector_picks",
    "rated_sets_clustered": "SELECT DISTINCT userId, movieId FROM ratings",
    "user_counts_clustered": "SELECT userId, count(*) AS n FROM ratings GROUP BY userId",
    "one_user_history": 'SELECT userId, movieId, rating, "timestamp" FROM ratings WHERE userId = 1',
    "one_user_given": """
        SELECT t.userId, t.movieId, round(t.score, 6) AS score, m.title, m.genres
        FROM (SELECT * FROM vector_top_all WHERE userId = 1) t ANTI JOIN ratings r
             ON r.userId = t.userId AND r.movieId = t.movieId
        LEFT JOIN movies m ON m.movieId = t.movieId""",
    "ranked_list": """
        SELECT userId, movieId, round(score, 6) AS score, CAST(n AS INTEGER) AS rank,
               lpad(CAST(n AS VARCHAR), 2, '0') AS rank_label
        FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY score DESC, movieId) AS n FROM vector_picks)""",
    "pick_size_histogram": """
        SELECT n_picks, count(*) AS n_users FROM (
            SELECT u.userId, CAST(count(p.movieId) AS INTEGER) AS n_picks
            FROM vector_users u LEFT JOIN vector_picks p USING (userId) GROUP BY u.userId) GROUP BY n_picks""",
    "used_catalogue": """
        SELECT * FROM movies WHERE movieId IN (SELECT movieId FROM vector_picks UNION SELECT movieId FROM popular)""",
    "genre_mix": """
        SELECT userId, genre, round(sum(w) / any_value(total), 6) AS share FROM (
            SELECT userId, genre, w, sum(w) OVER (PARTITION BY userId) AS total FROM (
                SELECT p.userId, g.genre, 1.0::DOUBLE / count(*) OVER (PARTITION BY p.userId, p.movieId) AS w
                FROM vector_picks p JOIN movie_genres g USING (movieId)))
        GROUP BY userId, genre""",
    "route_requests": """
        SELECT userId, 'personalized' AS type, rank, movieId, title, genres, round_even(score, 2) AS predictedRating
        FROM customers JOIN vector_picks USING (userId) LEFT JOIN movies USING (movieId)
        UNION ALL
        SELECT userId, 'popular', rank, movieId, title, genres, NULL
        FROM customers, popular_list WHERE userId NOT IN (SELECT id FROM user_factors)""",
    "rmse_fixed": """
        SELECT count(*) AS n, round(sqrt(avg(pow(list_dot_product(u.features, i.features) - r.rating, 2))), 6) AS rmse
        FROM ratings r JOIN user_factors u ON u.id = r.userId JOIN item_factors i ON i.id = r.movieId""",
    "hash_split": """
        SELECT CASE WHEN bucket < 8 THEN 'train' ELSE 'test' END AS part, count(*) AS n,
               CAST(sum(rating) AS BIGINT) AS stars, count(DISTINCT userId) AS n_users
        FROM split GROUP BY part""",
    "random_split": "SELECT count(*) AS n_rows, true AS same_rows, true AS near_80_pct FROM ratings",
    "rmse_global_mean": """
        SELECT count(*) AS n, round(sqrt(avg(pow((SELECT avg(rating) FROM train) - rating, 2))), 6) AS rmse FROM test""",
    "als_train": """
        SELECT 'user' AS side, count(DISTINCT userId) AS n_factors, 0 AS n_bad_length, 0 AS n_negative FROM train
        UNION ALL SELECT 'item', count(DISTINCT movieId), 0, 0 FROM train""",
    "als_predict": "SELECT count(*) AS n_predicted, 0 AS n_undefined, 0 AS n_negative FROM scored_test",
    "als_grid": """
        SELECT rank, reg_param, max_iter, (SELECT count(*) FROM scored_test) AS n_scored, true AS error_agrees,
               true AS best_agrees
        FROM (VALUES (10, 0.1::DOUBLE, 10), (20, 0.1::DOUBLE, 10), (10, 0.05::DOUBLE, 20))
             AS t(rank, reg_param, max_iter)""",
    "factor_scan": """
        SELECT DISTINCT 'user' AS side, userId AS id, 10 AS n FROM train
        UNION ALL SELECT DISTINCT 'item', movieId, 10 FROM train""",
    "model_roundtrip": """
        SELECT 'user' AS side, count(DISTINCT userId) AS n_factors, 10 AS rank, 'drop' AS cold_start FROM train
        UNION ALL SELECT 'item', count(DISTINCT movieId), 10, 'drop' FROM train""",
    "recommend_all": """
        SELECT DISTINCT userId, least(10, (SELECT count(DISTINCT movieId) FROM train)) AS n_top,
               CAST(least(10, (SELECT count(DISTINCT movieId) FROM train)) AS INTEGER) AS last_rank,
               true AS within_top, 0 AS n_rated_kept
        FROM train""",
    "recommend_users": """
        SELECT DISTINCT userId, least(10, (SELECT count(DISTINCT movieId) FROM train)) AS n_top, true AS adds_up,
               true AS ranks_in_a_row, 0 AS n_seen, 0 AS n_untitled
        FROM train SEMI JOIN customers USING (userId)""",
    "recommend_users_given": """
        SELECT t.userId, CAST(row_number() OVER (PARTITION BY t.userId ORDER BY t.score DESC, t.movieId) AS INTEGER) AS rank,
               t.movieId, m.title, m.genres, round_even(t.score, 2) AS predictedRating
        FROM (SELECT * FROM vector_top_all SEMI JOIN customers USING (userId) ANTI JOIN ratings USING (userId, movieId)) t
        LEFT JOIN movies m USING (movieId)""",
    "ranking_per_user": """
        SELECT userId, n_relevant, n_hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg
        FROM list_metrics WHERE relevant_from = 4""",
    "ranking_summary": """
        SELECT relevant_from, count(*) AS n_users, count(*) FILTER (n_hits > 0) AS n_users_hit, round(avg(precision), 6) AS precision,
               round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg
        FROM list_metrics GROUP BY relevant_from""",
    "film_self_information": "SELECT movieId, round(bits, 6) AS bits FROM film_bits",
    "novelty_per_list": """
        SELECT p.userId, count(*) AS n_films, count(*) - count(bits) AS n_unrated, round(avg(bits), 6) AS novelty
        FROM vector_picks p LEFT JOIN film_bits USING (movieId) GROUP BY p.userId""",
    "catalogue_exposure": """
        SELECT count(*) AS n_films, count(*) FILTER (times > 0) AS n_shown,
               round(count(*) FILTER (times > 0)::DOUBLE / count(*), 6) AS coverage, CAST(sum(times) AS BIGINT) AS n_slots,
               round(sum((2 * place - count_all - 1)::DOUBLE * times) / (any_value(count_all) * sum(times)::DOUBLE), 6) AS gini
        FROM (SELECT times, row_number() OVER (ORDER BY times) AS place, count(*) OVER () AS count_all
              FROM (SELECT m.movieId, count(p.userId) AS times FROM movies m LEFT JOIN vector_picks p USING (movieId) GROUP BY m.movieId))""",
    "implicit_confidence": """
        SELECT userId, movieId, rating, 1 AS preference, 1 + 40.0::DOUBLE * rating AS confidence FROM event_counts""",
    "implicit_train": """
        SELECT 'user' AS side, count(DISTINCT userId) AS n_factors, 0 AS n_bad_length, 0 AS n_negative FROM event_split WHERE bucket < 8
        UNION ALL SELECT 'item', count(DISTINCT movieId), 0, 0 FROM event_split WHERE bucket < 8""",
    "implicit_compared": """
        WITH seen AS (SELECT * FROM event_split WHERE bucket < 8), unseen AS (SELECT * FROM event_split WHERE bucket >= 8),
        best AS (SELECT movieId, sum(rating) AS score FROM seen GROUP BY movieId ORDER BY score DESC, movieId LIMIT 30),
        lists AS (
            SELECT u.userId, b.movieId, row_number() OVER (PARTITION BY u.userId ORDER BY b.score DESC, b.movieId) AS rank
            FROM (SELECT DISTINCT userId FROM seen) u CROSS JOIN best b
            ANTI JOIN seen s ON s.userId = u.userId AND s.movieId = b.movieId),
        hits AS (SELECT t.userId, count(*) AS n_relevant, count(l.movieId) AS n_hits
                 FROM unseen t LEFT JOIN lists l ON l.userId = t.userId AND l.movieId = t.movieId AND l.rank <= 10 GROUP BY t.userId)
        SELECT 'popular' AS lists, count(*) AS n_users, round(avg(n_hits / 10.0::DOUBLE), 6) AS precision,
               round(avg(n_hits::DOUBLE / n_relevant), 6) AS recall, true AS within_bounds, sum(n_hits) > 0 AS finds_some FROM hits
        UNION ALL SELECT 'model', count(DISTINCT userId), NULL, NULL, true, true FROM unseen""",
    "bayesian_average": "SELECT movieId, cnt, mean, round(score, 6) AS score FROM films",
    "rating_pool": """
        SELECT mood, movieId, cnt FROM films f JOIN mood_masks m ON (f.mask & m.mask) <> 0 WHERE cnt >= 38""",
    "request_ratings": "SELECT reqId, movieId, r FROM rated",
    "request_candidates": """
        SELECT p.reqId, p.wanted, p.era, p.reach, count(c.movieId) AS n_candidates
        FROM prepared p LEFT JOIN candidates c USING (reqId) GROUP BY p.reqId, p.wanted, p.era, p.reach""",
    "anchor_ladder": "SELECT wanted, era, tier, CAST(pos AS INTEGER) AS pos, movieId FROM anchors",
    "foldin_rows": "SELECT reqId, source, movieId, r, round(w, 6) AS w FROM fold_rows",
    "gram_matrix": """
        SELECT w.reqId, s.a, s.c, (w.w * s.total + coalesce(t.total, 0)) / 1000000.0::DOUBLE AS value
        FROM weights w
        JOIN (SELECT f.wanted, f.era, a.i AS a, c.i AS c,
                     CAST(sum(CAST(f.q[a.i + 1] AS BIGINT) * f.q[c.i + 1]) AS DOUBLE) AS total
              FROM anchors f, places a JOIN places c ON a.i <= c.i GROUP BY ALL) s USING (wanted, era)
        LEFT JOIN (SELECT f.reqId, a.i AS a, c.i AS c,
                          CAST(sum(CAST(f.q[a.i + 1] AS BIGINT) * f.q[c.i + 1]) AS DOUBLE) AS total
                   FROM rated f, places a JOIN places c ON a.i <= c.i GROUP BY ALL) t
               ON t.reqId = w.reqId AND t.a = s.a AND t.c = s.c""",
    "gram_rhs": """
        SELECT w.reqId, s.a, (w.w * s.total + coalesce(t.total, 0)) / 1000.0::DOUBLE AS value
        FROM weights w
        JOIN (SELECT f.wanted, f.era, a.i AS a, CAST(sum(5 * CAST(f.q[a.i + 1] AS BIGINT)) AS DOUBLE) AS total
              FROM anchors f, places a GROUP BY ALL) s USING (wanted, era)
        LEFT JOIN (SELECT f.reqId, a.i AS a, CAST(sum(f.r * CAST(f.q[a.i + 1] AS BIGINT)) AS DOUBLE) AS total
                   FROM rated f, places a GROUP BY ALL) t ON t.reqId = w.reqId AND t.a = s.a""",
    "foldin_solve": "SELECT reqId, 10 AS n_values, true AS non_negative, true AS solved FROM prepared",
    "genre_affinity": """
        SELECT reqId, genre, round(affinity, 6) AS affinity FROM affinities JOIN genre_bits USING (bit)""",
    "genre_fit": """
        SELECT r.reqId, r.movieId, round(m.fit, 6) AS fit
        FROM (SELECT DISTINCT userId AS reqId, movieId FROM ratings) r
        JOIN (SELECT movieId, mask FROM films) f USING (movieId) JOIN mask_fits m ON m.reqId = r.reqId AND m.mask = f.mask""",
    "mood_rank": """
        SELECT reqId, CAST(rank AS INTEGER) AS rank, movieId, floor(p * 100 + 0.5) / 100 AS predictedRating,
               round(rank_score, 6) AS rank_score
        FROM (
            SELECT *, row_number() OVER (PARTITION BY reqId ORDER BY rank_score DESC, cnt DESC, movieId) AS rank FROM (
                SELECT c.reqId, c.movieId, c.cnt, list_dot_product(u.features, c.features) AS p,
                       list_dot_product(u.features, c.features) + m.fit AS rank_score
                FROM candidates c JOIN user_factors u ON u.id = c.reqId
                JOIN mask_fits m ON m.reqId = c.reqId AND m.mask = c.mask
                ANTI JOIN rated r ON r.reqId = c.reqId AND r.movieId = c.movieId))
        WHERE rank <= 10""",
    "mood_recommend": """
        SELECT c.reqId, least(10, count(*)) AS n_picks, CAST(least(10, count(*)) AS INTEGER) AS last_rank, 0 AS n_wrong
        FROM candidates c ANTI JOIN rated r ON r.reqId = c.reqId AND r.movieId = c.movieId GROUP BY c.reqId""",
}


def _needed(sql: str, seen: dict[str, None]) -> None:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            seen[name] = None
            _needed(VIEWS[name], seen)


def statement(body: str) -> str:
    """The body with the views it needs, in definition order, as one statement."""
    seen: dict[str, None] = {}
    _needed(body, seen)
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in seen]
    body = body.strip()
    if body.startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body[5:]}" if ctes else body
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def all_statements() -> dict[str, str]:
    return {name: statement(body) for name, body in ORACLES.items()}

-- view txn
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, value AS amount, user_id, 'P' || (user_id % 5) AS product, event_type AS channel,
       CASE WHEN user_id % 11 <> 0 THEN user_id % 7 END AS region,
       CAST(regexp_extract(props, '[0-9]+') AS INTEGER) / 100.0::DOUBLE AS score, CAST(event_type = 'error' AS INTEGER) AS label
FROM events

-- view bnd
SELECT min(t) AS mn, max(t) AS mx FROM txn

-- view pos
SELECT txn.*, (t - mn) / CAST(mx - mn AS DOUBLE) AS pos, mn + 0.7::DOUBLE * (mx - mn) AS cut FROM txn, bnd

-- view lab
SELECT *, CASE WHEN pos < 0.5::DOUBLE THEN 'development' WHEN pos < 0.6::DOUBLE THEN 'calibration' WHEN pos < 0.7::DOUBLE THEN 'acceptance' ELSE 'production' END AS dataset_period,
       CASE WHEN pos < 0.5::DOUBLE THEN CAST(least(greatest(floor(pos / 0.5::DOUBLE * 5) + 1, 1), 5) AS INTEGER) END AS development_block,
       CASE WHEN pos >= 0.7::DOUBLE THEN CAST(floor((t - cut) / 86400) + 1 AS INTEGER) END AS batch
FROM pos

-- view acc
SELECT * FROM lab WHERE dataset_period = 'acceptance'

-- view prod
SELECT * FROM lab WHERE batch IS NOT NULL

-- view shadow
SELECT s.*, CAST((t - min(t) OVER ()) // 86400 + 1 AS INTEGER) AS shadow_batch
FROM (SELECT txn.* FROM txn, bnd WHERE t >= mn + ((mx - mn) * 2) // 3) s

-- query velocity_by_period
SELECT dataset_period, count(*) AS rows, round(avg(label), 4) AS prevalence, round(avg(n), 4) AS mean_prior_count, round(avg(CAST(h AS FLOAT)), 4) AS mean_hours
FROM (SELECT dataset_period, label, count(*) OVER w AS n, (t - max(t) OVER w) / 3600.0::DOUBLE AS h FROM lab
      WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY dataset_period

-- query contract_validation
SELECT 'documents' AS table_name, count(*) AS rows, count(*) FILTER (WHERE doc_id IS NULL) AS null_ids, count(doc_id) - count(DISTINCT doc_id) AS repeated_ids, CAST(0 AS BIGINT) AS bad_labels FROM documents
UNION ALL
SELECT 'labels', count(*), count(*) FILTER (WHERE doc_id IS NULL), count(doc_id) - count(DISTINCT doc_id), count(*) FILTER (WHERE toxic IS NULL OR toxic NOT IN (0, 1)) FROM labels

-- view joined
SELECT d.doc_id, source, n_chars, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic, l.doc_id IS NOT NULL AS identity_available FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id

-- query one_to_one_join
SELECT * FROM joined

-- query table_profile
SELECT unnest(['doc_id', 'source', 'n_chars', 'quality', 'toxic', 'identity_available']) AS "column", n AS rows,
       unnest([round(a, 6), round(b, 6), round(c, 6), round(d, 6), round(e, 6), round(f, 6)]) AS null_share
FROM (SELECT count(*) AS n, avg(CAST(doc_id IS NULL AS INT)) AS a, avg(CAST(source IS NULL AS INT)) AS b, avg(CAST(n_chars IS NULL AS INT)) AS c,
             avg(CAST(quality IS NULL AS INT)) AS d, avg(CAST(toxic IS NULL AS INT)) AS e, avg(CAST(identity_available IS NULL AS INT)) AS f FROM joined)

-- query temporal_bounds
SELECT mn AS first_t, mx AS last_t, mn + 0.5::DOUBLE * (mx - mn) AS development_end, mn + 0.6::DOUBLE * (mx - mn) AS calibration_end, mn + 0.7::DOUBLE * (mx - mn) AS acceptance_end FROM bnd

-- query temporal_periods
SELECT dataset_period, count(*) AS rows, round(avg(label), 6) AS prevalence, min(t) AS first_t, max(t) AS last_t FROM lab GROUP BY dataset_period

-- query development_blocks
SELECT development_block, count(*) AS rows, min(t) AS first_t, max(t) AS last_t FROM lab WHERE development_block IS NOT NULL GROUP BY development_block

-- query daily_batches
SELECT batch AS production_batch, count(*) AS rows, min(t) AS first_t, max(t) AS last_t FROM prod GROUP BY batch

-- query fold_membership
SELECT 'blocks_1_' || (k - 1) || '_to_' || k AS fold, CASE WHEN development_block < k THEN 'train' ELSE 'validation' END AS side, count(*) AS rows, min(t) AS first_t, max(t) AS last_t
FROM lab, (SELECT unnest([3, 4, 5]) AS k) WHERE development_block <= k GROUP BY ALL

-- query shadow_batches
SELECT shadow_batch, count(*) AS rows, round(avg(score), 6) AS score_mean FROM shadow GROUP BY shadow_batch

-- query union_batches
SELECT batch_id, count(*) AS rows, CAST(sum(label) AS DOUBLE) AS positives, round(avg(score), 6) AS score_mean
FROM (SELECT 'production_' || lpad(CAST(batch AS VARCHAR), 3, '0') AS batch_id, score, label FROM prod
      UNION ALL SELECT 'shadow_' || lpad(CAST(shadow_batch AS VARCHAR), 3, '0'), score, NULL FROM shadow) GROUP BY batch_id

-- query causal_count_recency
SELECT event_id, CAST(count(*) OVER w AS INTEGER) AS user_prior_count, round(CAST(CAST((t - max(t) OVER w) / 3600.0::DOUBLE AS FLOAT) AS DOUBLE), 3) AS user_hours_since_previous
FROM txn WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)

-- query causal_amount_mean_ratio
SELECT event_id, round(CAST(CAST(m AS FLOAT) AS DOUBLE), 2) AS user_prior_amount_mean,
       round(CAST(CAST(CASE WHEN m <> 0 THEN amount / m END AS FLOAT) AS DOUBLE), 2) AS user_amount_to_prior_mean
FROM (SELECT event_id, amount, coalesce(sum(coalesce(amount, 0)) OVER w, 0) / nullif(count(*) OVER w, 0) AS m
      FROM (SELECT event_id, user_id, t, CASE WHEN event_id % 7 <> 0 THEN amount END AS amount FROM txn)
      WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))

-- query causal_two_keys
SELECT event_id, CAST(count(*) OVER w AS INTEGER) AS pair_prior_count, round(CAST(CAST((t - max(t) OVER w) / 3600.0::DOUBLE AS FLOAT) AS DOUBLE), 3) AS pair_hours_since_previous
FROM txn WINDOW w AS (PARTITION BY product, region ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)

-- query causal_daily_ties
SELECT o_orderkey AS event_id, CAST(count(*) OVER w AS INTEGER) AS user_prior_count,
       round(CAST(CAST((epoch(o_orderdate) - max(epoch(o_orderdate)) OVER w) / 3600.0::DOUBLE AS FLOAT) AS DOUBLE), 2) AS user_hours_since_previous
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY epoch(o_orderdate) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)

-- query frozen_state_lookup
SELECT event_id, CAST(coalesce(h.n, 0) AS INTEGER) AS user_prior_count, round(CAST(CAST((prod.t - h.last) / 3600.0::DOUBLE AS FLOAT) AS DOUBLE), 3) AS user_hours_since_previous
FROM prod LEFT JOIN (SELECT user_id, count(*) AS n, max(t) AS last FROM lab WHERE batch IS NULL GROUP BY user_id) h ON h.user_id IS NOT DISTINCT FROM prod.user_id

-- query stateless_features
SELECT event_id, round(CAST(CAST(ln(1 + greatest(amount, 0.0)) AS FLOAT) AS DOUBLE), 2) AS amount_log1p, round(CAST(CAST(amount - floor(amount) AS FLOAT) AS DOUBLE), 2) AS amount_fraction,
       round(CAST(CAST(t / 86400.0::DOUBLE AS FLOAT) AS DOUBLE), 2) AS elapsed_day,
       round(CAST(CAST(sin(2 * pi() * (t % 86400) / 3600.0::DOUBLE / 24) AS FLOAT) AS DOUBLE), 2) AS hour_sin, round(CAST(CAST(cos(2 * pi() * (t % 86400) / 3600.0::DOUBLE / 24) AS FLOAT) AS DOUBLE), 2) AS hour_cos,
       round(CAST(CAST(sin(2 * pi() * (t % 604800) / 86400.0::DOUBLE / 7) AS FLOAT) AS DOUBLE), 2) AS weekday_sin, round(CAST(CAST(cos(2 * pi() * (t % 604800) / 86400.0::DOUBLE / 7) AS FLOAT) AS DOUBLE), 2) AS weekday_cos
FROM txn

-- query missing_counts
SELECT CAST(region IS NULL AS INTEGER) AS missing_count_identity, 0 AS missing_count_vendor,
       CAST(region IS NULL AS INTEGER) + CAST(product IS NULL AS INTEGER) + CAST(amount IS NULL AS INTEGER) AS missing_count_all, count(*) AS rows FROM txn GROUP BY ALL

-- query category_levels
SELECT "column", coalesce(value, '__MISSING__') AS value, count(*) AS rows
FROM (SELECT unnest(['product', 'channel', 'region']) AS "column", unnest([product, channel, CAST(region AS VARCHAR)]) AS value FROM lab WHERE dataset_period = 'development') GROUP BY ALL

-- query frequency_encoding
SELECT prod.event_id, round(CAST(CAST(coalesce(f.n / f.total, 0) AS FLOAT) AS DOUBLE), 5) AS user_id__frequency,
       CASE WHEN prod.channel IN (SELECT channel FROM lab WHERE dataset_period = 'development') THEN prod.channel ELSE '__UNKNOWN__' END AS channel
FROM prod LEFT JOIN (SELECT user_id, count(*) AS n, sum(count(*)) OVER () AS total FROM lab WHERE dataset_period = 'development' GROUP BY user_id) f ON f.user_id = prod.user_id

-- query drop_rules
SELECT "column", round(m, 6) AS missing_share, n AS distinct_values, m > 0.98 OR n <= 1 AS dropped
FROM (SELECT "column", avg(CAST(value IS NULL AS INT)) AS m, count(DISTINCT value) + max(CAST(value IS NULL AS INT)) AS n
      FROM (SELECT unnest(['product', 'region', 'amount', 'constant', 'sparse']) AS "column",
                   unnest([product, CAST(region AS VARCHAR), CAST(amount AS VARCHAR), '1', CASE WHEN event_id % 100 = 0 THEN '1' END]) AS value FROM lab) GROUP BY "column")

-- query unknown_mapping
SELECT batch, CASE WHEN product = 'P3' THEN '__UNKNOWN__' ELSE product END AS product, count(*) AS rows FROM prod GROUP BY ALL

-- view cal
SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM lab WHERE dataset_period = 'calibration'

-- query review_thresholds
SELECT x AS review_rate, score AS threshold FROM cal, (SELECT unnest([0.005::DOUBLE, 0.01::DOUBLE, 0.02::DOUBLE, 0.05::DOUBLE]) AS x) WHERE r = CAST(ceil(round((n - 1) * (1 - x), 9)) AS BIGINT) + 1

-- view conf
SELECT batch, count(*) FILTER (WHERE label = 1 AND score >= 0.8::DOUBLE) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.8::DOUBLE) AS fp,
       count(*) FILTER (WHERE label = 1 AND score < 0.8::DOUBLE) AS fn, count(*) FILTER (WHERE label = 0 AND score < 0.8::DOUBLE) AS tn, count(*) AS n,
       coalesce(sum(amount) FILTER (WHERE label = 1), 0) AS fa, coalesce(sum(amount) FILTER (WHERE label = 1 AND score >= 0.8::DOUBLE), 0) AS ca
FROM prod GROUP BY batch

-- query confusion_by_batch
SELECT batch, tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative, n AS rows,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
       round(fp / nullif(fp + tn, 0), 6) AS false_positive_rate, round(fn / nullif(tp + fn, 0), 6) AS false_negative_rate FROM conf

-- view steps
SELECT batch, p, n, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM (SELECT batch, score, sum(label) AS p, count(*) AS n FROM prod GROUP BY batch, score)
WINDOW w AS (PARTITION BY batch ORDER BY score DESC ROWS UNBOUNDED PRECEDING)

-- query average_precision_by_batch
SELECT batch, CAST(sum(p) AS BIGINT) AS positives, round(sum(p * cp / cn) / nullif(sum(p), 0), 6) AS pr_auc FROM steps GROUP BY batch

-- query roc_auc_by_batch
SELECT batch, CAST(sum(n - p) AS BIGINT) AS negatives, round(sum((n - p) * (cp - p / 2)) / nullif(sum(p) * sum(n - p), 0), 6) AS roc_auc FROM steps GROUP BY batch

-- view brierb
SELECT batch, round(avg((score - label) * (score - label)), 6) AS brier,
       round(avg(-(label * ln(c) + (1 - label) * ln(1 - c))), 6) AS log_loss
FROM (SELECT *, least(greatest(score, 2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE) AS c FROM prod) GROUP BY batch

-- query score_summary
SELECT batch, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS prevalence, round(avg(score), 6) AS score_mean,
       round(quantile_cont(score, 0.5), 6) AS score_p50, round(quantile_cont(score, 0.95), 6) AS score_p95 FROM prod GROUP BY batch

-- view pedges
SELECT batch, list_sort(list_distinct(list_transform(quantile_cont(score, [0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.30000000000000004::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6000000000000001::DOUBLE, 0.7000000000000001::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE]), lambda x: round(x, 9)))) AS e
FROM prod GROUP BY batch

-- view eceb
SELECT batch, round(sum(n * gap) / sum(n), 6) AS ece
FROM (SELECT prod.batch, len(list_filter(e[2:len(e) - 1], lambda x: x < score)) AS b, count(*) AS n, abs(avg(label) - avg(score)) AS gap FROM prod JOIN pedges ON prod.batch = pedges.batch GROUP BY ALL) GROUP BY batch

-- query reliability_table
SELECT rows, round(mean_probability, 6) AS mean_probability, round(observed_rate, 6) AS observed_rate, minimum_probability, maximum_probability, CAST(row_number() OVER (ORDER BY b) AS INTEGER) AS bin
FROM (SELECT len(list_filter(e[2:len(e) - 1], lambda x: x < score)) AS b, count(*) AS rows, avg(score) AS mean_probability, avg(label) AS observed_rate, min(score) AS minimum_probability, max(score) AS maximum_probability
      FROM acc, (SELECT edges AS e FROM nedges WHERE feature = 'score') GROUP BY b)

-- view budget
SELECT CAST(review_rate AS DOUBLE) AS review_rate, threshold, tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative, n AS rows,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1,
       round(fp / nullif(fp + tn, 0), 4) AS false_positive_rate, round(fn / nullif(tp + fn, 0), 4) AS false_negative_rate,
       round(fa, 4) AS fraud_amount, round(ca, 4) AS captured_amount, round(CASE WHEN fa > 0 THEN ca / fa END, 4) AS captured_rate, round((tp + fp) / n, 4) AS realised_rate
FROM (SELECT review_rate, threshold, count(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp, count(*) FILTER (WHERE label = 0 AND score >= threshold) AS fp,
             count(*) FILTER (WHERE label = 1 AND score < threshold) AS fn, count(*) FILTER (WHERE label = 0 AND score < threshold) AS tn, count(*) AS n,
             coalesce(sum(amount) FILTER (WHERE label = 1), 0) AS fa, coalesce(sum(amount) FILTER (WHERE label = 1 AND score >= threshold), 0) AS ca
      FROM acc, (SELECT x AS review_rate, score AS threshold FROM (SELECT score AS score, r, n FROM cal), (SELECT unnest([0.01::DOUBLE, 0.02::DOUBLE, 0.05::DOUBLE]) AS x) WHERE r = CAST(ceil(round((n - 1) * (1 - x), 9)) AS BIGINT) + 1) GROUP BY ALL)

-- query captured_amount
SELECT batch, round(fa, 4) AS fraud_amount, round(ca, 4) AS captured_amount, round(CASE WHEN fa > 0 THEN ca / fa END, 4) AS captured_rate FROM conf

-- view nlong
SELECT batch, dataset_period, t // 86400 AS day, unnest(['amount', 'score']) AS feature, unnest([amount, score]) AS value FROM lab

-- view nedges
SELECT feature, list_sort(list_distinct(list_transform(quantile_cont(value, [0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.30000000000000004::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6000000000000001::DOUBLE, 0.7000000000000001::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE]), lambda x: round(x, 9)))) AS edges
FROM nlong WHERE dataset_period = 'acceptance' GROUP BY feature

-- view cells
SELECT feature, unnest(range(0, len(edges) - 1)) AS bin FROM nedges

-- view binned
SELECT batch, dataset_period, day, nlong.feature, len(list_filter(edges[2:len(edges) - 1], lambda x: x <= value)) AS bin FROM nlong JOIN nedges ON nlong.feature = nedges.feature

-- view refshare
SELECT cells.feature, cells.bin, (coalesce(n, 0) + 1e-6::DOUBLE) / sum(coalesce(n, 0) + 1e-6::DOUBLE) OVER (PARTITION BY cells.feature) AS e
FROM cells LEFT JOIN (SELECT feature, bin, count(*) AS n FROM binned WHERE dataset_period = 'acceptance' GROUP BY ALL) c ON c.feature = cells.feature AND c.bin = cells.bin

-- view nowshare
SELECT g.batch, cells.feature, cells.bin, (coalesce(n, 0) + 1e-6::DOUBLE) / sum(coalesce(n, 0) + 1e-6::DOUBLE) OVER (PARTITION BY g.batch, cells.feature) AS a
FROM cells JOIN (SELECT DISTINCT batch FROM prod) g ON true LEFT JOIN (SELECT batch, feature, bin, count(*) AS n FROM binned WHERE batch IS NOT NULL GROUP BY ALL) c ON c.batch = g.batch AND c.feature = cells.feature AND c.bin = cells.bin

-- view diverge
SELECT batch, nowshare.feature, sum((a - e) * ln(a / e)) AS psi, sqrt(greatest(sum(a * log2(a / ((a + e) / 2)) + e * log2(e / ((a + e) / 2))) / 2, 0)) AS js
FROM nowshare JOIN refshare ON nowshare.feature = refshare.feature AND nowshare.bin = refshare.bin GROUP BY batch, nowshare.feature

-- view psib
SELECT batch, feature, round(psi, 6) AS psi FROM diverge

-- query psi_by_batch
SELECT * FROM psib

-- query score_js
SELECT batch, round(js, 6) AS js FROM diverge WHERE feature = 'score'

-- view clong
SELECT batch, dataset_period, unnest(['product', 'channel', 'region', 'user_id']) AS feature, coalesce(unnest([product, channel, CAST(region AS VARCHAR), CAST(user_id AS VARCHAR)]), '__MISSING__') AS value FROM lab

-- view cref
SELECT feature, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature) AS total FROM clong WHERE dataset_period = 'acceptance' GROUP BY feature, value

-- view cnow
SELECT batch, feature, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY batch, feature) AS total FROM clong WHERE batch IS NOT NULL GROUP BY batch, feature, value

-- view cjsb
SELECT batch, feature, round(sqrt(greatest(sum(CASE WHEN a > 0 THEN a * log2(a / ((a + e) / 2)) ELSE 0 END + CASE WHEN e > 0 THEN e * log2(e / ((a + e) / 2)) ELSE 0 END) / 2, 0)), 6) AS js
FROM (SELECT g.batch, u.feature, coalesce(cnow.n / cnow.total, 0) AS a, coalesce(cref.n / cref.total, 0) AS e
      FROM (SELECT DISTINCT batch FROM prod) g JOIN (SELECT feature, value FROM cref UNION SELECT feature, value FROM cnow) u ON true
      LEFT JOIN cnow ON cnow.batch = g.batch AND cnow.feature = u.feature AND cnow.value = u.value LEFT JOIN cref ON cref.feature = u.feature AND cref.value = u.value) GROUP BY batch, feature

-- query categorical_js
SELECT * FROM cjsb

-- view unseenb
SELECT batch, cnow.feature, round(sum(CASE WHEN cref.value IS NULL THEN cnow.n ELSE 0 END) / sum(cnow.n), 6) AS unseen_rate
FROM cnow LEFT JOIN cref ON cref.feature = cnow.feature AND cref.value = cnow.value GROUP BY batch, cnow.feature

-- query unseen_rate
SELECT * FROM unseenb

-- query missingness_shift
SELECT batch, unnest(['region', 'amount']) AS feature, unnest([round(abs(r - rr), 6), round(abs(a - ra), 6)]) AS missingness_shift
FROM (SELECT batch, avg(CAST(region IS NULL AS INT)) AS r, avg(CAST(amount IS NULL AS INT)) AS a FROM prod GROUP BY batch), (SELECT avg(CAST(region IS NULL AS INT)) AS rr, avg(CAST(amount IS NULL AS INT)) AS ra FROM acc)

-- view wassb
SELECT batch, w.feature, round(sum(gap * coalesce(step, 0)) / any_value(scale), 6) AS wasserstein
FROM (SELECT batch, feature, abs(sum(c) OVER o / sum(c) OVER p - sum(r) OVER o / sum(r) OVER p) AS gap, lead(value) OVER (PARTITION BY batch, feature ORDER BY value) - value AS step
      FROM (SELECT batch, feature, value, sum(c) AS c, sum(r) AS r
            FROM (SELECT batch, feature, value, 1 AS c, 0 AS r FROM nlong WHERE batch IS NOT NULL
                  UNION ALL SELECT g.batch, feature, value, 0, 1 FROM nlong, (SELECT DISTINCT batch FROM prod) g WHERE dataset_period = 'acceptance') GROUP BY batch, feature, value)
      WINDOW o AS (PARTITION BY batch, feature ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY batch, feature)) w
JOIN (SELECT feature, greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), stddev_pop(value), 1e-6::DOUBLE) AS scale FROM nlong WHERE dataset_period = 'acceptance' GROUP BY feature) s ON s.feature = w.feature
GROUP BY batch, w.feature

-- query wasserstein_by_batch
SELECT * FROM wassb

-- query drift_severity
SELECT batch, CASE WHEN max(p) > 0.05::DOUBLE THEN 'critical' WHEN max(p) > 0.01::DOUBLE THEN 'warning' ELSE 'healthy' END AS severity, count(*) FILTER (WHERE p > 0.01::DOUBLE) AS alerts
FROM (SELECT batch, round(psi, 6) AS p FROM diverge) GROUP BY batch

-- view draws
SELECT iter, days[CAST('0x' || substr(md5(iter || ':' || j), 1, 8) AS BIGINT) % len(days) + 1] AS day, count(*) AS mult
FROM (SELECT list_sort(list(DISTINCT t // 86400)) AS days FROM acc), range(500) i(iter), range(7) k(j) GROUP BY 1, 2

-- view jsamples
SELECT s.iter, round(sqrt(greatest(sum(a * log2(a / ((a + e) / 2)) + e * log2(e / ((a + e) / 2))) / 2, 0)), 9) AS js
FROM (SELECT g.iter, cells.feature, cells.bin, (coalesce(n, 0) + 1e-6::DOUBLE) / sum(coalesce(n, 0) + 1e-6::DOUBLE) OVER (PARTITION BY g.iter, cells.feature) AS a
      FROM cells JOIN (SELECT DISTINCT iter FROM draws) g ON true
      LEFT JOIN (SELECT iter, feature, bin, sum(mult) AS n FROM binned JOIN draws ON draws.day = binned.day WHERE dataset_period = 'acceptance' GROUP BY ALL) c ON c.iter = g.iter AND c.feature = cells.feature AND c.bin = cells.bin) s
JOIN refshare ON refshare.feature = s.feature AND refshare.bin = s.bin WHERE s.feature = 'score' GROUP BY s.iter

-- view samples
SELECT s.iter, s.feature, round(sum((a - e) * ln(a / e)), 9) AS psi
FROM (SELECT g.iter, cells.feature, cells.bin, (coalesce(n, 0) + 1e-6::DOUBLE) / sum(coalesce(n, 0) + 1e-6::DOUBLE) OVER (PARTITION BY g.iter, cells.feature) AS a
      FROM cells JOIN (SELECT DISTINCT iter FROM draws) g ON true
      LEFT JOIN (SELECT iter, feature, bin, sum(mult) AS n FROM binned JOIN draws ON draws.day = binned.day WHERE dataset_period = 'acceptance' GROUP BY ALL) c ON c.iter = g.iter AND c.feature = cells.feature AND c.bin = cells.bin) s
JOIN refshare ON refshare.feature = s.feature AND refshare.bin = s.bin GROUP BY s.iter, s.feature

-- view dlimits
SELECT feature, round(quantile_cont(psi, 0.95), 9) AS warning_limit, round(quantile_cont(psi, 0.99), 9) AS critical_limit FROM samples GROUP BY feature

-- query bootstrap_drift_limits
SELECT feature, round(warning_limit, 6) AS warning_limit, round(critical_limit, 6) AS critical_limit FROM dlimits

-- query alert_count_limits
SELECT 'warning' AS kind, list_sort(list(w))[CAST(ceil(round((count(*) - 1) * 0.95::DOUBLE, 9)) AS BIGINT) + 1] AS "limit" FROM (SELECT iter, count(*) FILTER (WHERE psi > warning_limit) AS w FROM samples JOIN dlimits ON samples.feature = dlimits.feature GROUP BY iter)
UNION ALL
SELECT 'critical', list_sort(list(w))[CAST(ceil(round((count(*) - 1) * 0.99::DOUBLE, 9)) AS BIGINT) + 1] FROM (SELECT iter, count(*) FILTER (WHERE psi > critical_limit) AS w FROM samples JOIN dlimits ON samples.feature = dlimits.feature GROUP BY iter)

-- view records
SELECT batch, feature, CASE WHEN value IS NULL THEN 'schema_missing' ELSE 'psi' END AS metric, CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE value END AS value,
       CASE WHEN value IS NULL THEN 0 ELSE coalesce(warning_limit, 0) END AS warning_limit, CASE WHEN value IS NULL THEN 0 ELSE coalesce(critical_limit, 0) END AS critical_limit,
       CASE WHEN value IS NULL OR value > critical_limit THEN 'critical' WHEN value > warning_limit THEN 'warning' ELSE 'healthy' END AS severity
FROM (SELECT g.batch, f.feature, round(diverge.psi, 9) AS value, warning_limit, critical_limit FROM (SELECT DISTINCT batch FROM prod) g JOIN (SELECT unnest(['amount', 'score', 'absent']) AS feature) f ON true
      LEFT JOIN diverge ON diverge.batch = g.batch AND diverge.feature = f.feature LEFT JOIN dlimits ON dlimits.feature = f.feature)

-- query drift_compare
SELECT batch, feature, metric, round(value, 6) AS value, round(warning_limit, 6) AS warning_limit, round(critical_limit, 6) AS critical_limit, severity FROM records

-- query drift_ordered
SELECT batch, CAST(row_number() OVER (PARTITION BY batch ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, round(value, 6) DESC, feature) AS INTEGER) AS place, feature, severity, round(value, 6) AS value FROM records

-- query performance_limits
SELECT metric, round(quantile_cont(v, 0.05), 6) AS warning_limit, round(quantile_cont(v, 0.01), 6) AS critical_limit
FROM (SELECT unnest(['pr_auc', 'recall']) AS metric, unnest([ap, rc]) AS v
      FROM (SELECT iter, sum(p * cp / cn) / sum(p) AS ap, sum(CASE WHEN score >= 0.8::DOUBLE THEN p ELSE 0 END) / sum(p) AS rc
            FROM (SELECT iter, score, p, sum(p) OVER w AS cp, sum(n) OVER w AS cn
                  FROM (SELECT iter, score, sum(mult * label) AS p, sum(mult) AS n FROM acc JOIN draws ON draws.day = acc.t // 86400 GROUP BY iter, score)
                  WINDOW w AS (PARTITION BY iter ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY iter)) GROUP BY metric

-- query label_maturity
SELECT batch, count(*) AS rows, CASE WHEN batch + 2 <= max(batch) OVER () THEN 'mature' ELSE 'pending' END AS label_status FROM prod GROUP BY batch

-- query segment_topk
SELECT segment, value, rows FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY rows DESC, value) AS place
      FROM (SELECT segment, coalesce(value, '__MISSING__') AS value, count(*) AS rows FROM (SELECT unnest(['region', 'user_id']) AS segment, unnest([CAST(region AS VARCHAR), CAST(user_id AS VARCHAR)]) AS value FROM acc) GROUP BY ALL)) WHERE place <= 5

-- view topregion
SELECT coalesce(CAST(region AS VARCHAR), '__MISSING__') AS value FROM acc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3

-- view segcount
SELECT batch, segment, value, count(*) AS rows, sum(label) AS positives, sum(1 - label) AS negatives, count(*) FILTER (WHERE label = 1 AND score >= 0.8::DOUBLE) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.8::DOUBLE) AS fp,
       count(*) FILTER (WHERE label = 1 AND score < 0.8::DOUBLE) AS fn, coalesce(sum(amount) FILTER (WHERE label = 1), 0) AS fa, coalesce(sum(amount) FILTER (WHERE label = 1 AND score >= 0.8::DOUBLE), 0) AS ca
FROM (SELECT batch, label, score, amount, unnest(['region', 'product']) AS segment,
             unnest([CASE WHEN coalesce(CAST(region AS VARCHAR), '__MISSING__') IN (SELECT value FROM topregion) THEN coalesce(CAST(region AS VARCHAR), '__MISSING__') ELSE '__OTHER__' END, product]) AS value FROM prod) GROUP BY ALL

-- view seg
SELECT batch, segment, value, CASE WHEN pool THEN 2 ELSE 1 END AS window_batches, rows, positives, negatives, tp, fp, fn, fa, ca, positives >= 12 AND negatives >= 30 AS enough
FROM (SELECT n.batch, n.segment, n.value, pool, n.rows + CASE WHEN pool THEN coalesce(p.rows, 0) ELSE 0 END AS rows, n.positives + CASE WHEN pool THEN coalesce(p.positives, 0) ELSE 0 END AS positives,
             n.negatives + CASE WHEN pool THEN coalesce(p.negatives, 0) ELSE 0 END AS negatives, n.tp + CASE WHEN pool THEN coalesce(p.tp, 0) ELSE 0 END AS tp, n.fp + CASE WHEN pool THEN coalesce(p.fp, 0) ELSE 0 END AS fp,
             n.fn + CASE WHEN pool THEN coalesce(p.fn, 0) ELSE 0 END AS fn, n.fa + CASE WHEN pool THEN coalesce(p.fa, 0) ELSE 0 END AS fa, n.ca + CASE WHEN pool THEN coalesce(p.ca, 0) ELSE 0 END AS ca
      FROM (SELECT s.*, q.seq, (positives < 12 OR negatives < 30) AND q.seq > 1 AS pool FROM segcount s JOIN (SELECT batch, row_number() OVER (ORDER BY batch) AS seq FROM (SELECT DISTINCT batch FROM prod)) q ON q.batch = s.batch) n
      LEFT JOIN (SELECT s.*, q.seq FROM segcount s JOIN (SELECT batch, row_number() OVER (ORDER BY batch) AS seq FROM (SELECT DISTINCT batch FROM prod)) q ON q.batch = s.batch) p ON p.seq + 1 = n.seq AND p.segment = n.segment AND p.value = n.value)

-- query segment_metrics_pooled
SELECT batch, segment, value, window_batches, rows, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives, CASE WHEN enough THEN 'reported' ELSE 'suppressed' END AS status,
       CASE WHEN enough THEN round(positives / rows, 6) END AS prevalence, CASE WHEN enough THEN round(coalesce(tp / nullif(tp + fp, 0), 0), 6) END AS precision,
       CASE WHEN enough THEN round(coalesce(tp / nullif(tp + fn, 0), 0), 6) END AS recall, CASE WHEN enough THEN CAST(fp AS DOUBLE) END AS false_positive, CASE WHEN enough THEN CAST(fn AS DOUBLE) END AS false_negative,
       CASE WHEN enough AND fa > 0 THEN round(ca / fa, 6) END AS captured_rate FROM seg

-- view topseg
SELECT batch, name AS top_false_negative_segment FROM (SELECT batch, segment || '=' || value AS name, row_number() OVER (PARTITION BY batch ORDER BY fn DESC, segment || '=' || value) AS place FROM seg WHERE enough) WHERE place = 1

-- query top_segments
SELECT * FROM topseg

-- view bm
SELECT *, CASE WHEN shift > 0.02::DOUBLE THEN 'critical' WHEN shift > 0.004::DOUBLE THEN 'warning' ELSE 'healthy' END AS drift_severity,
       CASE WHEN label_status <> 'mature' OR recall IS NULL THEN 'unavailable' WHEN recall < 0.19::DOUBLE THEN 'critical' WHEN recall < 0.22::DOUBLE THEN 'warning' ELSE 'healthy' END AS performance_severity,
       coalesce(label_status = 'mature' AND recall < 0.2::DOUBLE, false) AS primary_critical
FROM (SELECT batch, count(*) AS rows, round(abs(avg(score) - (SELECT avg(score) FROM acc)), 9) AS shift, round(avg(CASE WHEN label = 1 THEN CAST(score >= 0.8::DOUBLE AS INT) END), 9) AS recall,
             CASE WHEN batch + 2 <= max(batch) OVER () THEN 'mature' ELSE 'pending' END AS label_status FROM prod GROUP BY batch)

-- query batch_metrics
SELECT batch, rows, round(shift, 6) AS shift, round(recall, 6) AS recall, label_status, drift_severity, performance_severity, primary_critical FROM bm

-- query action_policy
SELECT batch, CASE WHEN primary_critical AND pp THEN 'retrain_evaluation_required' WHEN drift_severity = 'critical' OR performance_severity = 'critical' OR (w AND pw) THEN 'investigate' ELSE 'continue_monitoring' END AS action,
       CASE WHEN primary_critical AND pp THEN 'Primary performance guardrail breached in two mature batches'
            WHEN drift_severity = 'critical' OR performance_severity = 'critical' THEN concat_ws('; ', CASE WHEN drift_severity = 'critical' THEN 'Critical data or prediction drift' END, CASE WHEN performance_severity = 'critical' THEN 'Critical mature-label performance breach' END)
            WHEN w AND pw THEN 'Warning persisted for two consecutive batches' ELSE 'No sustained or critical guardrail breach' END AS action_evidence
FROM (SELECT *, coalesce(lag(w) OVER (ORDER BY batch), false) AS pw, coalesce(last_value(CASE WHEN label_status = 'mature' THEN primary_critical END IGNORE NULLS) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS pp
      FROM (SELECT *, drift_severity = 'warning' OR performance_severity = 'warning' AS w FROM bm))

-- query health_timeline
SELECT batch, CASE WHEN 'critical' IN (drift_severity, performance_severity) THEN 'critical' WHEN 'warning' IN (drift_severity, performance_severity) THEN 'warning' WHEN 'unavailable' IN (drift_severity, performance_severity) THEN 'unavailable' ELSE 'healthy' END AS health FROM bm

-- query latest_batch
SELECT batch, rows, round(shift, 6) AS shift, label_status FROM bm ORDER BY batch DESC LIMIT 1

-- query metric_unpivot
SELECT batch, 'shift' AS metric, round(shift, 6) AS value FROM bm UNION ALL SELECT batch, 'recall', round(recall, 6) FROM bm

-- query public_projection
SELECT batch, rows, round(recall, 6) AS recall, drift_severity FROM bm

-- view imp
SELECT batch, i.feature, reference_mean_abs, mean_abs AS current_mean_abs, mean_abs - reference_mean_abs AS change, abs(mean_abs - reference_mean_abs) AS absolute_change
FROM (SELECT batch, nlong.feature, avg(abs(value - m)) AS mean_abs FROM nlong JOIN (SELECT feature, avg(value) AS m FROM nlong WHERE dataset_period = 'acceptance' GROUP BY feature) c ON c.feature = nlong.feature WHERE batch IS NOT NULL GROUP BY ALL) i
JOIN (SELECT nlong.feature, avg(abs(value - m)) AS reference_mean_abs FROM nlong JOIN (SELECT feature, avg(value) AS m FROM nlong WHERE dataset_period = 'acceptance' GROUP BY feature) c ON c.feature = nlong.feature WHERE dataset_period = 'acceptance' GROUP BY ALL) r ON r.feature = i.feature

-- query shap_rank_change
SELECT batch, feature, round(reference_mean_abs, 6) AS reference_mean_abs, round(current_mean_abs, 6) AS current_mean_abs, round(change, 6) AS change, round(absolute_change, 6) AS absolute_change,
       CAST(rank() OVER (PARTITION BY batch ORDER BY reference_mean_abs DESC) AS INTEGER) AS reference_rank, CAST(rank() OVER (PARTITION BY batch ORDER BY current_mean_abs DESC) AS INTEGER) AS current_rank FROM imp

-- view drivers
SELECT batch, feature, metric AS metrics, round(2 * CASE severity WHEN 'critical' THEN 2 ELSE 1 END + least(greatest((value - warning_limit) / greatest(abs(critical_limit - warning_limit), 1e-9::DOUBLE), 0), 5)
       + 2 * CAST(metric = 'schema_missing' AS INT) + CASE WHEN max(ch) OVER (PARTITION BY batch) > 0 THEN ch / max(ch) OVER (PARTITION BY batch) ELSE 0 END, 9) AS driver_score
FROM (SELECT records.*, coalesce(round(imp.absolute_change, 9), 0) AS ch FROM records LEFT JOIN imp ON imp.batch = records.batch AND imp.feature = records.feature WHERE severity <> 'healthy')

-- view ranked
SELECT batch, CAST(row_number() OVER (PARTITION BY batch ORDER BY driver_score DESC, feature) AS INTEGER) AS place, feature, metrics, driver_score FROM drivers

-- query driver_ranking
SELECT batch, place, feature, metrics, round(driver_score, 4) AS driver_score FROM ranked WHERE place <= 10

-- query investigations
SELECT bm.batch, concat_ws(', ', CASE WHEN drift_severity <> 'healthy' THEN 'data_drift' END, CASE WHEN performance_severity IN ('warning', 'critical') THEN 'performance_change' END) AS classification,
       ranked.feature AS leading_driver, top_false_negative_segment
FROM bm LEFT JOIN ranked ON ranked.batch = bm.batch AND place = 1 LEFT JOIN topseg ON topseg.batch = bm.batch
WHERE NOT (drift_severity = 'healthy' AND performance_severity IN ('healthy', 'unavailable'))

-- query challenger_windows
SELECT batch, rows, positives, CASE WHEN k <= 2 THEN 'evaluation' WHEN k <= c THEN 'calibration' ELSE 'training' END AS role
FROM (SELECT *, (SELECT min(k) FROM m2 WHERE k > 2 AND cp > 0 AND cn > 0) AS c FROM m2)

-- view m2
SELECT *, sum(CASE WHEN k > 2 THEN positives END) OVER (ORDER BY k) AS cp, sum(CASE WHEN k > 2 THEN rows - positives END) OVER (ORDER BY k) AS cn
FROM (SELECT *, row_number() OVER (ORDER BY batch DESC) AS k FROM (SELECT batch, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, max(batch) OVER () AS latest FROM prod GROUP BY batch) WHERE batch + 2 <= latest)

-- view jlimits
SELECT round(quantile_cont(js, 0.95), 9) AS warning_limit, round(quantile_cont(js, 0.99), 9) AS critical_limit FROM jsamples

-- view pdrift
SELECT batch, round(js, 9) AS js, warning_limit, critical_limit, CASE WHEN round(js, 9) > critical_limit THEN 'critical' WHEN round(js, 9) > warning_limit THEN 'warning' ELSE 'healthy' END AS prediction_severity
FROM diverge, jlimits WHERE feature = 'score'

-- query score_js_limits
SELECT batch, round(js, 6) AS js, round(warning_limit, 6) AS warning_limit, round(critical_limit, 6) AS critical_limit, prediction_severity FROM pdrift

-- view allowed
SELECT list_sort(list(w))[CAST(ceil(round((count(*) - 1) * 0.95::DOUBLE, 9)) AS BIGINT) + 1] AS mw, list_sort(list(c))[CAST(ceil(round((count(*) - 1) * 0.99::DOUBLE, 9)) AS BIGINT) + 1] AS mc
FROM (SELECT iter, count(*) FILTER (WHERE psi > warning_limit) AS w, count(*) FILTER (WHERE psi > critical_limit) AS c FROM samples JOIN dlimits ON samples.feature = dlimits.feature GROUP BY iter)

-- view gsev
SELECT batch, critical_features, alerting_features, CASE WHEN critical_features > mc OR prediction_severity = 'critical' THEN 'critical' WHEN alerting_features > mw OR prediction_severity = 'warning' THEN 'warning' ELSE 'healthy' END AS severity
FROM (SELECT r.batch, count(*) FILTER (WHERE severity = 'critical') AS critical_features, count(*) FILTER (WHERE severity <> 'healthy') AS alerting_features, any_value(prediction_severity) AS prediction_severity
      FROM records r LEFT JOIN pdrift ON pdrift.batch = r.batch GROUP BY r.batch), allowed

-- query global_severity
SELECT * FROM gsev

-- view acted
SELECT batch, label_status, CASE WHEN primary_critical AND pp THEN 'retrain_evaluation_required' WHEN drift_severity = 'critical' OR performance_severity = 'critical' OR (w AND pw) THEN 'investigate' ELSE 'continue_monitoring' END AS action,
       CASE WHEN primary_critical AND pp THEN 'Primary performance guardrail breached in two mature batches'
            WHEN drift_severity = 'critical' OR performance_severity = 'critical' THEN concat_ws('; ', CASE WHEN drift_severity = 'critical' THEN 'Critical data or prediction drift' END, CASE WHEN performance_severity = 'critical' THEN 'Critical mature-label performance breach' END)
            WHEN w AND pw THEN 'Warning persisted for two consecutive batches' ELSE 'No sustained or critical guardrail breach' END AS action_evidence
FROM (SELECT *, coalesce(lag(w) OVER (ORDER BY batch), false) AS pw, coalesce(last_value(CASE WHEN label_status = 'mature' THEN primary_critical END IGNORE NULLS) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS pp
      FROM (SELECT *, drift_severity = 'warning' OR performance_severity = 'warning' AS w FROM bm))

-- query label_freshness
SELECT count(*) FILTER (WHERE label_status = 'mature') AS mature, count(*) FILTER (WHERE label_status = 'pending') AS pending, max(batch) FILTER (WHERE label_status = 'mature') AS latest_mature, arg_max(action, batch) AS current_action FROM acted

-- query last_evidence
SELECT batch, action, action_evidence FROM acted ORDER BY batch DESC LIMIT 5

-- query recommendation_history
SELECT 'production' AS stream, batch, action, action_evidence, coalesce(lag(action) OVER (ORDER BY batch) = action, false) AS repeated FROM acted ORDER BY batch DESC LIMIT 8

-- query confusion_pivot
SELECT batch, actual, CASE WHEN actual = 0 THEN tn ELSE fn END AS predicted_0, CASE WHEN actual = 0 THEN fp ELSE tp END AS predicted_1
FROM conf, (SELECT unnest([CAST(0 AS INTEGER), CAST(1 AS INTEGER)]) AS actual) WHERE batch = (SELECT max(batch) FROM bm WHERE label_status = 'mature')

-- query score_movement
SELECT batch, 'js' AS metric, round(js, 6) AS value FROM diverge WHERE feature = 'score' UNION ALL SELECT batch, 'shift', round(shift, 6) FROM bm

-- query review_budget
SELECT * FROM budget

-- query ece_by_batch
SELECT * FROM eceb

-- query brier_logloss
SELECT * FROM brierb

-- query budget_unpivot
SELECT review_rate, u.metric, CASE u.metric WHEN 'precision' THEN budget.precision WHEN 'recall' THEN recall WHEN 'realised_rate' THEN realised_rate ELSE captured_rate END AS value
FROM budget, (SELECT unnest(['precision', 'recall', 'realised_rate', 'captured_rate']) AS metric) u

-- query calibration_unpivot
SELECT batch, 'ece' AS metric, ece AS value FROM eceb UNION ALL SELECT batch, 'brier', brier FROM brierb

-- query feature_metrics
SELECT batch, feature, 'psi' AS metric, psi AS value FROM psib UNION ALL SELECT batch, feature, 'wasserstein', wasserstein FROM wassb
UNION ALL SELECT batch, feature, 'js', js FROM cjsb WHERE feature <> 'user_id' UNION ALL SELECT batch, feature, 'unseen_rate', unseen_rate FROM unseenb WHERE feature <> 'user_id'
UNION ALL SELECT batch, feature, 'missingness_shift', round(abs(g - r), 6)
FROM (SELECT batch, unnest(['amount', 'score', 'product', 'channel', 'region']) AS feature, unnest([avg((amount IS NULL)::INT), avg((score IS NULL)::INT), avg((product IS NULL)::INT), avg((channel IS NULL)::INT), avg((region IS NULL)::INT)]) AS g FROM prod GROUP BY batch)
JOIN (SELECT unnest(['amount', 'score', 'product', 'channel', 'region']) AS feature, unnest([avg((amount IS NULL)::INT), avg((score IS NULL)::INT), avg((product IS NULL)::INT), avg((channel IS NULL)::INT), avg((region IS NULL)::INT)]) AS r FROM acc) USING (feature)

-- view whole
SELECT batch, label, score, amount FROM prod UNION ALL SELECT -1, label, score, amount FROM acc

-- view wsteps
SELECT batch, p, n, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM (SELECT batch, score, sum(label) AS p, count(*) AS n FROM whole GROUP BY batch, score)
WINDOW w AS (PARTITION BY batch ORDER BY score DESC ROWS UNBOUNDED PRECEDING)

-- view wedges
SELECT batch, list_sort(list_distinct(list_transform(quantile_cont(score, [0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.30000000000000004::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6000000000000001::DOUBLE, 0.7000000000000001::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE]), lambda x: round(x, 9)))) AS e
FROM whole GROUP BY batch

-- view wcal
SELECT batch, sum(n * gap) / sum(n) AS ece
FROM (SELECT whole.batch, len(list_filter(e[2:len(e) - 1], lambda x: x < score)) AS b, count(*) AS n, abs(avg(label) - avg(score)) AS gap FROM whole JOIN wedges ON whole.batch = wedges.batch GROUP BY ALL) GROUP BY batch

-- view wrank
SELECT batch, sum(p * cp / cn) / nullif(sum(p), 0) AS pr_auc, sum((n - p) * (cp - p / 2)) / nullif(sum(p) * sum(n - p), 0) AS roc_auc FROM wsteps GROUP BY batch

-- view wcount
SELECT batch, count(*) FILTER (WHERE label = 1 AND score >= 0.8::DOUBLE) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.8::DOUBLE) AS fp,
       count(*) FILTER (WHERE label = 1 AND score < 0.8::DOUBLE) AS fn, count(*) FILTER (WHERE label = 0 AND score < 0.8::DOUBLE) AS tn, count(*) AS n,
       coalesce(sum(amount) FILTER (WHERE label = 1), 0) AS fa, coalesce(sum(amount) FILTER (WHERE label = 1 AND score >= 0.8::DOUBLE), 0) AS ca,
       avg(score) AS score_mean, quantile_cont(score, 0.5) AS score_p50, quantile_cont(score, 0.95) AS score_p95, avg((score - label) * (score - label)) AS brier,
       avg(-(label * ln(least(greatest(score, 2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE)) + (1 - label) * ln(1 - least(greatest(score, 2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE)))) AS log_loss
FROM whole GROUP BY batch

-- view wrow
SELECT c.batch, 0.8::DOUBLE AS threshold, n AS rows, tp + fn AS positives, fp + tn AS negatives, (tp + fn) / n AS prevalence, tp + fp AS predicted_positive, (tp + fp) / n AS review_rate,
       tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
       coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, fp / nullif(fp + tn, 0) AS false_positive_rate, fn / nullif(tp + fn, 0) AS false_negative_rate, pr_auc, roc_auc,
       brier AS brier_score, log_loss, ece AS expected_calibration_error, score_mean, score_p50, score_p95, fa AS fraud_amount, ca AS captured_amount, CASE WHEN fa > 0 THEN ca / fa END AS captured_rate
FROM wcount c JOIN wrank r ON r.batch = c.batch JOIN wcal e ON e.batch = c.batch

-- query full_metric_row
SELECT batch, threshold, rows, positives, negatives, round(prevalence, 4) AS prevalence, predicted_positive, round(review_rate, 4) AS review_rate, true_positive, false_positive, false_negative, true_negative,
       round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, round(false_positive_rate, 4) AS false_positive_rate, round(false_negative_rate, 4) AS false_negative_rate,
       round(pr_auc, 4) AS pr_auc, round(roc_auc, 4) AS roc_auc, round(brier_score, 4) AS brier_score, round(log_loss, 4) AS log_loss, round(expected_calibration_error, 4) AS expected_calibration_error,
       round(score_mean, 4) AS score_mean, round(score_p50, 4) AS score_p50, round(score_p95, 4) AS score_p95, round(fraud_amount, 4) AS fraud_amount, round(captured_amount, 4) AS captured_amount, round(captured_rate, 4) AS captured_rate
FROM wrow WHERE batch > 0

-- view redrawn
SELECT iter, score, label, unnest(range(mult)) AS k FROM acc JOIN draws ON draws.day = acc.t // 86400

-- view rcal
SELECT iter, sum(n * gap) / sum(n) AS ece
FROM (SELECT redrawn.iter, len(list_filter(e[2:len(e) - 1], lambda x: x < score)) AS b, count(*) AS n, abs(avg(label) - avg(score)) AS gap
      FROM redrawn JOIN (SELECT iter, list_sort(list_distinct(list_transform(quantile_cont(score, [0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.30000000000000004::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6000000000000001::DOUBLE, 0.7000000000000001::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE]), lambda x: round(x, 9)))) AS e FROM redrawn GROUP BY iter) q ON q.iter = redrawn.iter GROUP BY ALL) GROUP BY iter

-- view rrank
SELECT iter, sum(p * cp / cn) / nullif(sum(p), 0) AS pr_auc
FROM (SELECT iter, p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM (SELECT iter, score, sum(label) AS p, count(*) AS n FROM redrawn GROUP BY iter, score) WINDOW w AS (PARTITION BY iter ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY iter

-- view rcount
SELECT iter, count(*) FILTER (WHERE label = 1 AND score >= 0.8::DOUBLE) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.8::DOUBLE) AS fp,
       count(*) FILTER (WHERE label = 1 AND score < 0.8::DOUBLE) AS fn, count(*) FILTER (WHERE label = 0 AND score < 0.8::DOUBLE) AS tn, avg((score - label) * (score - label)) AS brier FROM redrawn GROUP BY iter

-- view rlong
SELECT unnest(['pr_auc', 'precision', 'recall', 'false_positive_rate', 'false_negative_rate', 'brier_score', 'expected_calibration_error', 'prevalence_shift']) AS metric,
       unnest([pr_auc, coalesce(tp / nullif(tp + fp, 0), 0), tp / (tp + fn), fp / (fp + tn), fn / (tp + fn), brier, ece, abs((tp + fn) / (tp + fp + fn + tn) - (SELECT avg(label) FROM acc))]) AS v
FROM rcount c JOIN rrank r ON r.iter = c.iter JOIN rcal e ON e.iter = c.iter WHERE tp + fn > 0 AND fp + tn > 0

-- view flimits
SELECT metric, CASE WHEN metric IN ('pr_auc', 'precision', 'recall') THEN 'lower' ELSE 'higher' END AS direction,
       round(CASE WHEN metric IN ('pr_auc', 'precision', 'recall') THEN quantile_cont(v, 0.05) ELSE quantile_cont(v, 0.95) END, 9) AS warning_limit,
       round(CASE WHEN metric IN ('pr_auc', 'precision', 'recall') THEN quantile_cont(v, 0.01) ELSE quantile_cont(v, 0.99) END, 9) AS critical_limit FROM rlong GROUP BY metric

-- query full_performance_limits
SELECT metric, direction, round(warning_limit, 6) AS warning_limit, round(critical_limit, 6) AS critical_limit FROM flimits

-- view judged
SELECT batch, metric, value, reference_value, warning_limit, critical_limit, direction,
       CASE WHEN value IS NULL THEN 'unavailable' WHEN direction = 'lower' AND value < critical_limit OR direction = 'higher' AND value > critical_limit THEN 'critical'
            WHEN direction = 'lower' AND value < warning_limit OR direction = 'higher' AND value > warning_limit THEN 'warning' ELSE 'healthy' END AS status
FROM (SELECT batch, m.metric, warning_limit, critical_limit, direction, round(CASE WHEN ok THEN now[m.i] END, 9) AS value, CASE WHEN m.i < 8 OR ok THEN round(ref[m.i], 9) END AS reference_value
      FROM (SELECT w.batch, w.batch + 2 <= max(w.batch) OVER () AND w.positives > 0 AND w.negatives > 0 AS ok,
                   [w.pr_auc, w.precision, w.recall, w.false_positive_rate, w.false_negative_rate, w.brier_score, w.expected_calibration_error, abs(w.prevalence - a.prevalence)] AS now,
                   [a.pr_auc, a.precision, a.recall, a.false_positive_rate, a.false_negative_rate, a.brier_score, a.expected_calibration_error, 0] AS ref
            FROM wrow w, wrow a WHERE w.batch > 0 AND a.batch = -1) x,
           (SELECT unnest(['pr_auc', 'precision', 'recall', 'false_positive_rate', 'false_negative_rate', 'brier_score', 'expected_calibration_error', 'prevalence_shift']) AS metric, unnest(range(1, 9)) AS i) m
      JOIN flimits ON flimits.metric = m.metric)

-- query performance_records
SELECT batch, metric, round(value, 6) AS value, round(reference_value, 6) AS reference_value, round(warning_limit, 6) AS warning_limit, round(critical_limit, 6) AS critical_limit, direction, status FROM judged

-- view psummary
SELECT batch, CASE WHEN bool_or(status = 'critical') THEN 'critical' WHEN bool_or(status = 'warning') THEN 'warning' WHEN bool_and(status = 'unavailable') THEN 'unavailable' ELSE 'healthy' END AS performance_severity,
       bool_or(status = 'critical' AND metric IN ('pr_auc', 'recall')) AS primary_critical FROM judged GROUP BY batch

-- query performance_summary
SELECT * FROM psummary

-- view mdaily
SELECT t // 86400 AS day, unnest(['region', 'amount']) AS feature, unnest([sum((region IS NULL)::INT), sum((amount IS NULL)::INT)]) AS gaps, count(*) AS n FROM acc GROUP BY 1

-- view mbase
SELECT feature, sum(gaps) / sum(n) AS base FROM mdaily GROUP BY feature

-- view mlimits
SELECT feature, round(quantile_cont(v, 0.95), 9) AS warning_limit, round(quantile_cont(v, 0.99), 9) AS critical_limit
FROM (SELECT s.feature, abs(share - base) AS v FROM (SELECT iter, feature, sum(gaps * mult) / sum(n * mult) AS share FROM mdaily JOIN draws ON draws.day = mdaily.day GROUP BY iter, feature) s JOIN mbase ON mbase.feature = s.feature) GROUP BY feature

-- view mrecords
SELECT batch, feature, 'missingness_shift' AS metric, value, warning_limit, critical_limit, CASE WHEN value > critical_limit THEN 'critical' WHEN value > warning_limit THEN 'warning' ELSE 'healthy' END AS severity
FROM (SELECT batch, x.feature, round(abs(g - base), 9) AS value, warning_limit, critical_limit
      FROM (SELECT batch, unnest(['region', 'amount']) AS feature, unnest([avg((region IS NULL)::INT), avg((amount IS NULL)::INT)]) AS g FROM prod GROUP BY batch) x
      JOIN mbase ON mbase.feature = x.feature JOIN mlimits ON mlimits.feature = x.feature)

-- query missingness_records
SELECT batch, feature, metric, round(value, 6) AS value, round(warning_limit, 6) AS warning_limit, round(critical_limit, 6) AS critical_limit, severity FROM mrecords

-- view alarms
SELECT batch, bool_or(metric = 'missingness_shift') AS gaps, bool_or(metric <> 'missingness_shift') AS moved
FROM (SELECT batch, metric, severity FROM records UNION ALL SELECT batch, metric, severity FROM mrecords) WHERE severity <> 'healthy' GROUP BY batch

-- view failures
SELECT batch, bool_or(metric = 'prevalence_shift') AS p, bool_or(metric IN ('brier_score', 'expected_calibration_error')) AS c,
       bool_or(metric IN ('pr_auc', 'precision', 'recall', 'false_positive_rate', 'false_negative_rate')) AS q FROM judged WHERE status IN ('warning', 'critical') GROUP BY batch

-- query investigation_classes
SELECT g.batch, drift_severity, performance_severity,
       coalesce(nullif(concat_ws(', ', CASE WHEN gaps THEN 'data_quality_failure' END, CASE WHEN moved THEN 'covariate_drift' END, CASE WHEN prediction_severity <> 'healthy' THEN 'prediction_drift' END,
                CASE WHEN p THEN 'prevalence_shift' END, CASE WHEN c THEN 'calibration_drift' END, CASE WHEN q THEN 'confirmed_performance_degradation' END), ''), 'monitoring_signal') AS classification
FROM (SELECT batch, severity AS drift_severity FROM gsev) g JOIN psummary s ON s.batch = g.batch LEFT JOIN pdrift ON pdrift.batch = g.batch LEFT JOIN alarms ON alarms.batch = g.batch LEFT JOIN failures ON failures.batch = g.batch
WHERE NOT (drift_severity = 'healthy' AND performance_severity IN ('healthy', 'unavailable'))

-- query investigation_drilldown
SELECT ranked.batch, place, feature, metrics, round(driver_score, 4) AS driver_score FROM ranked JOIN bm ON bm.batch = ranked.batch
WHERE place <= 10 AND NOT (drift_severity = 'healthy' AND performance_severity IN ('healthy', 'unavailable'))

-- view cday
SELECT batch, dataset_period, t // 86400 AS day, unnest(['product', 'channel', 'region']) AS feature, coalesce(unnest([product, channel, CAST(region AS VARCHAR)]), '__MISSING__') AS value FROM lab

-- view gday
SELECT batch, dataset_period, t // 86400 AS day, unnest(['amount', 'product', 'channel', 'region']) AS feature, unnest([(amount IS NULL)::INT, (product IS NULL)::INT, (channel IS NULL)::INT, (region IS NULL)::INT]) AS gap FROM lab

-- view ascale
SELECT greatest(quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25), stddev_pop(amount), 1e-6::DOUBLE) AS scale FROM acc

-- view wdraw
SELECT iter, sum(gap * coalesce(step, 0)) / any_value(scale) AS v
FROM (SELECT iter, abs(sum(c) OVER o / sum(c) OVER p - sum(r) OVER o / sum(r) OVER p) AS gap, lead(value) OVER (PARTITION BY iter ORDER BY value) - value AS step
      FROM (SELECT iter, value, sum(c) AS c, sum(r) AS r
            FROM (SELECT iter, amount AS value, mult AS c, 0 AS r FROM acc JOIN draws ON draws.day = acc.t // 86400
                  UNION ALL SELECT g.iter, amount, 0, 1 FROM acc, (SELECT DISTINCT iter FROM draws) g) WHERE value IS NOT NULL GROUP BY iter, value)
      WINDOW o AS (PARTITION BY iter ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY iter)), ascale GROUP BY iter

-- view jdraw
SELECT iter, feature, sqrt(greatest(sum(a * log2(a / ((a + e) / 2)) + e * log2(e / ((a + e) / 2))) / 2, 0)) AS v
FROM (SELECT g.iter, l.feature, (coalesce(x.n, 0) + 1e-6::DOUBLE) / sum(coalesce(x.n, 0) + 1e-6::DOUBLE) OVER w AS a, (l.n + 1e-6::DOUBLE) / sum(l.n + 1e-6::DOUBLE) OVER w AS e
      FROM (SELECT feature, value, count(*) AS n FROM cday WHERE dataset_period = 'acceptance' GROUP BY ALL) l JOIN (SELECT DISTINCT iter FROM draws) g ON true
      LEFT JOIN (SELECT iter, feature, value, sum(mult) AS n FROM cday JOIN draws ON draws.day = cday.day WHERE dataset_period = 'acceptance' GROUP BY ALL) x ON x.iter = g.iter AND x.feature = l.feature AND x.value = l.value
      WINDOW w AS (PARTITION BY g.iter, l.feature)) GROUP BY iter, feature

-- view gbase
SELECT feature, avg(gap) AS base FROM gday WHERE dataset_period = 'acceptance' GROUP BY feature

-- view fsamples
SELECT iter, feature, metric, round(v, 9) AS v FROM (
  SELECT iter, 'amount' AS feature, 'normalized_wasserstein' AS metric, v FROM wdraw
  UNION ALL SELECT iter, feature, 'psi', psi FROM samples WHERE feature = 'amount'
  UNION ALL SELECT iter, feature, 'jensen_shannon', v FROM jdraw
  UNION ALL SELECT iter, feature, 'unseen_category_rate', 0 FROM jdraw
  UNION ALL SELECT iter, s.feature, 'missingness_shift', abs(share - base)
            FROM (SELECT iter, feature, sum(gap * mult) / sum(mult) AS share FROM gday JOIN draws ON draws.day = gday.day WHERE dataset_period = 'acceptance' GROUP BY iter, feature) s JOIN gbase ON gbase.feature = s.feature)

-- view flim
SELECT feature, CASE WHEN feature = 'amount' THEN 'numeric' ELSE 'categorical' END AS kind, metric, round(quantile_cont(v, 0.95), 9) AS warning_limit, round(quantile_cont(v, 0.99), 9) AS critical_limit FROM fsamples GROUP BY feature, metric

-- view psamples
SELECT iter, 'score_jensen_shannon' AS metric, js AS v FROM jsamples
UNION ALL SELECT iter, 'score_mean_shift', round(abs(sum(score * mult) / sum(mult) - any_value(m)), 9) FROM acc JOIN draws ON draws.day = acc.t // 86400, (SELECT avg(score) AS m FROM acc) GROUP BY iter

-- view plim
SELECT metric, round(quantile_cont(v, 0.95), 9) AS warning_limit, round(quantile_cont(v, 0.99), 9) AS critical_limit FROM psamples GROUP BY metric

-- query monitor_limits
SELECT feature, kind, metric, round(warning_limit, 6) AS warning_limit, round(critical_limit, 6) AS critical_limit FROM (SELECT * FROM flim UNION ALL SELECT 'score', 'prediction', metric, warning_limit, critical_limit FROM plim)

-- view wnow
SELECT batch, sum(gap * coalesce(step, 0)) / any_value(scale) AS v
FROM (SELECT batch, abs(sum(c) OVER o / sum(c) OVER p - sum(r) OVER o / sum(r) OVER p) AS gap, lead(value) OVER (PARTITION BY batch ORDER BY value) - value AS step
      FROM (SELECT batch, value, sum(c) AS c, sum(r) AS r
            FROM (SELECT batch, amount AS value, 1 AS c, 0 AS r FROM prod UNION ALL SELECT g.batch, amount, 0, 1 FROM acc, (SELECT DISTINCT batch FROM prod) g) WHERE value IS NOT NULL GROUP BY batch, value)
      WINDOW o AS (PARTITION BY batch ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY batch)), ascale GROUP BY batch

-- view ccells
SELECT batch, feature, value, sum(c) AS c, sum(r) AS r
FROM (SELECT batch, feature, value, 1 AS c, 0 AS r FROM cday WHERE batch IS NOT NULL UNION ALL SELECT g.batch, feature, value, 0, 1 FROM cday, (SELECT DISTINCT batch FROM prod) g WHERE dataset_period = 'acceptance') GROUP BY ALL

-- view fvalues
SELECT batch, feature, metric, round(v, 9) AS value FROM (
  SELECT batch, 'amount' AS feature, 'normalized_wasserstein' AS metric, v FROM wnow
  UNION ALL SELECT batch, feature, 'psi', psi FROM diverge WHERE feature = 'amount'
  UNION ALL SELECT batch, feature, 'jensen_shannon', sqrt(greatest(sum(a * log2(a / ((a + e) / 2)) + e * log2(e / ((a + e) / 2))) / 2, 0))
            FROM (SELECT batch, feature, (c + 1e-6::DOUBLE) / sum(c + 1e-6::DOUBLE) OVER w AS a, (r + 1e-6::DOUBLE) / sum(r + 1e-6::DOUBLE) OVER w AS e FROM ccells WINDOW w AS (PARTITION BY batch, feature)) GROUP BY batch, feature
  UNION ALL SELECT batch, feature, 'unseen_category_rate', sum(CASE WHEN r = 0 THEN c ELSE 0 END) / sum(c) FROM ccells GROUP BY batch, feature
  UNION ALL SELECT batch, x.feature, 'missingness_shift', abs(g - base) FROM (SELECT batch, feature, avg(gap) AS g FROM gday WHERE batch IS NOT NULL GROUP BY batch, feature) x JOIN gbase ON gbase.feature = x.feature)

-- view mfull
SELECT batch, v.feature, kind AS feature_kind, v.metric, value, warning_limit, critical_limit, CASE WHEN value > critical_limit THEN 'critical' WHEN value > warning_limit THEN 'warning' ELSE 'healthy' END AS severity
FROM fvalues v JOIN flim ON flim.feature = v.feature AND flim.metric = v.metric

-- query monitor_records
SELECT batch, feature, feature_kind, metric, round(value, 6) AS value, round(warning_limit, 6) AS warning_limit, round(critical_limit, 6) AS critical_limit, severity FROM mfull

-- view mscores
SELECT batch, x.metric, value, warning_limit, critical_limit, CASE WHEN value > critical_limit THEN 'critical' WHEN value > warning_limit THEN 'warning' ELSE 'healthy' END AS severity
FROM (SELECT batch, 'score_jensen_shannon' AS metric, round(js, 9) AS value FROM diverge WHERE feature = 'score'
      UNION ALL SELECT batch, 'score_mean_shift', round(abs(avg(score) - any_value(m)), 9) FROM prod, (SELECT avg(score) AS m FROM acc) GROUP BY batch) x JOIN plim ON plim.metric = x.metric

-- query monitor_prediction
SELECT batch, metric, round(value, 6) AS value, round(warning_limit, 6) AS warning_limit, round(critical_limit, 6) AS critical_limit, severity FROM mscores

-- view fallowed
SELECT list_sort(list(w))[CAST(ceil(round((count(*) - 1) * 0.95::DOUBLE, 9)) AS BIGINT) + 1] AS mw, list_sort(list(c))[CAST(ceil(round((count(*) - 1) * 0.99::DOUBLE, 9)) AS BIGINT) + 1] AS mc
FROM (SELECT iter, count(*) FILTER (WHERE k > 0) AS w, count(*) FILTER (WHERE k = 2) AS c
      FROM (SELECT iter, s.feature, max(CASE WHEN v > critical_limit THEN 2 WHEN v > warning_limit THEN 1 ELSE 0 END) AS k FROM fsamples s JOIN flim ON flim.feature = s.feature AND flim.metric = s.metric GROUP BY iter, s.feature) GROUP BY iter)

-- query monitor_summary
SELECT f.batch, w AS warning_features, c AS critical_features, mw AS warning_feature_limit, mc AS critical_feature_limit, p.severity AS prediction_severity,
       CASE WHEN c > mc OR p.severity = 'critical' THEN 'critical' WHEN w > mw OR p.severity = 'warning' THEN 'warning' ELSE 'healthy' END AS global_severity
FROM (SELECT batch, count(*) FILTER (WHERE k > 0) AS w, count(*) FILTER (WHERE k = 2) AS c FROM (SELECT batch, feature, max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS k FROM mfull GROUP BY batch, feature) GROUP BY batch) f
JOIN (SELECT batch, CASE max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'healthy' END AS severity FROM mscores GROUP BY batch) p ON p.batch = f.batch, fallowed

-- view msum
SELECT f.batch, w AS warning_features, c AS critical_features, p.severity AS prediction_severity,
       CASE WHEN c > mc OR p.severity = 'critical' THEN 'critical' WHEN w > mw OR p.severity = 'warning' THEN 'warning' ELSE 'healthy' END AS drift_severity
FROM (SELECT batch, count(*) FILTER (WHERE k > 0) AS w, count(*) FILTER (WHERE k = 2) AS c FROM (SELECT batch, feature, max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS k FROM mfull GROUP BY batch, feature) GROUP BY batch) f
JOIN (SELECT batch, CASE max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'healthy' END AS severity FROM mscores GROUP BY batch) p ON p.batch = f.batch, fallowed

-- view bfull
SELECT w.batch, span.day_start, span.day_end, CASE WHEN w.batch + 2 <= max(w.batch) OVER () THEN 'mature' ELSE 'pending' END AS label_status, msum.* EXCLUDE (batch), s.* EXCLUDE (batch), w.* EXCLUDE (batch)
FROM wrow w JOIN msum ON msum.batch = w.batch JOIN psummary s ON s.batch = w.batch JOIN (SELECT batch, min(t) / 86400 AS day_start, max(t) / 86400 AS day_end FROM prod GROUP BY batch) span ON span.batch = w.batch WHERE w.batch > 0

-- view bacted
SELECT *, CASE WHEN primary_critical AND pp THEN 'retrain_evaluation_required' WHEN drift_severity = 'critical' OR performance_severity = 'critical' OR (wn AND pw) THEN 'investigate' ELSE 'continue_monitoring' END AS action,
       CASE WHEN primary_critical AND pp THEN 'Primary performance guardrail breached in two mature batches'
            WHEN drift_severity = 'critical' OR performance_severity = 'critical' THEN concat_ws('; ', CASE WHEN drift_severity = 'critical' THEN 'Critical data or prediction drift' END, CASE WHEN performance_severity = 'critical' THEN 'Critical mature-label performance breach' END)
            WHEN wn AND pw THEN 'Warning persisted for two consecutive batches' ELSE 'No sustained or critical guardrail breach' END AS action_evidence
FROM (SELECT *, coalesce(lag(wn) OVER (ORDER BY batch), false) AS pw, coalesce(last_value(CASE WHEN label_status = 'mature' THEN primary_critical END IGNORE NULLS) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS pp
      FROM (SELECT *, drift_severity = 'warning' OR performance_severity = 'warning' AS wn FROM bfull))

-- query batch_records
SELECT 'production' AS stream, b.batch, rows, round(day_start, 4) AS elapsed_day_start, round(day_end, 4) AS elapsed_day_end, label_status, batch + 2 AS label_available_at_batch, round(score_mean, 4) AS score_mean, round(score_p50, 4) AS score_p50,
       round(score_p95, 4) AS score_p95, round(review_rate, 4) AS review_rate, 0.8::DOUBLE AS review_threshold, warning_features, critical_features, prediction_severity, drift_severity, round(j, 4) AS score_jensen_shannon, round(m, 4) AS score_mean_shift,
       performance_severity, primary_critical, CASE WHEN ok THEN positives END AS positives, CASE WHEN ok THEN round(precision, 4) END AS precision, CASE WHEN ok THEN round(recall, 4) END AS recall, CASE WHEN ok THEN round(f1, 4) END AS f1,
       CASE WHEN ok THEN round(false_positive_rate, 4) END AS false_positive_rate, CASE WHEN ok THEN round(false_negative_rate, 4) END AS false_negative_rate, CASE WHEN ok THEN round(pr_auc, 4) END AS pr_auc, CASE WHEN ok THEN round(roc_auc, 4) END AS roc_auc,
       CASE WHEN ok THEN round(brier_score, 4) END AS brier_score, CASE WHEN ok THEN round(expected_calibration_error, 4) END AS expected_calibration_error, CASE WHEN ok THEN round(fraud_amount, 4) END AS fraud_amount,
       CASE WHEN ok THEN round(captured_amount, 4) END AS captured_amount, CASE WHEN ok THEN round(captured_rate, 4) END AS captured_rate, action, action_evidence
FROM (SELECT *, label_status = 'mature' AS ok FROM bacted) b JOIN (SELECT batch AS bb, max(CASE WHEN metric = 'score_jensen_shannon' THEN value END) AS j, max(CASE WHEN metric = 'score_mean_shift' THEN value END) AS m FROM mscores GROUP BY batch) x ON bb = batch

-- view mseq
SELECT s.*, dense_rank() OVER (ORDER BY s.batch) AS seq FROM segcount s WHERE s.batch + 2 <= (SELECT max(batch) FROM prod)

-- view mseg
SELECT batch, segment, value, CASE WHEN pool THEN 2 ELSE 1 END AS window_batches, rows, positives, negatives, tp, fp, fn, fa, ca, positives >= 12 AND negatives >= 30 AS enough
FROM (SELECT n.batch, n.segment, n.value, pool, n.rows + CASE WHEN pool THEN coalesce(p.rows, 0) ELSE 0 END AS rows, n.positives + CASE WHEN pool THEN coalesce(p.positives, 0) ELSE 0 END AS positives,
             n.negatives + CASE WHEN pool THEN coalesce(p.negatives, 0) ELSE 0 END AS negatives, n.tp + CASE WHEN pool THEN coalesce(p.tp, 0) ELSE 0 END AS tp, n.fp + CASE WHEN pool THEN coalesce(p.fp, 0) ELSE 0 END AS fp,
             n.fn + CASE WHEN pool THEN coalesce(p.fn, 0) ELSE 0 END AS fn, n.fa + CASE WHEN pool THEN coalesce(p.fa, 0) ELSE 0 END AS fa, n.ca + CASE WHEN pool THEN coalesce(p.ca, 0) ELSE 0 END AS ca
      FROM (SELECT *, (positives < 12 OR negatives < 30) AND seq > 1 AS pool FROM mseq) n LEFT JOIN mseq p ON p.seq + 1 = n.seq AND p.segment = n.segment AND p.value = n.value)

-- query mature_segment_metrics
SELECT 'production' AS stream, batch, segment, value, window_batches, rows, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives, CASE WHEN enough THEN 'reported' ELSE 'suppressed' END AS status,
       CASE WHEN enough THEN round(positives / rows, 6) END AS prevalence, CASE WHEN enough THEN round(coalesce(tp / nullif(tp + fp, 0), 0), 6) END AS precision,
       CASE WHEN enough THEN round(coalesce(tp / nullif(tp + fn, 0), 0), 6) END AS recall, CASE WHEN enough THEN CAST(fp AS DOUBLE) END AS false_positive, CASE WHEN enough THEN CAST(fn AS DOUBLE) END AS false_negative,
       CASE WHEN enough AND fa > 0 THEN round(ca / fa, 6) END AS captured_rate FROM mseg

-- view mtop
SELECT batch, max(CASE WHEN a = 1 THEN name END) AS fn_name, max(CASE WHEN b = 1 THEN name END) AS fp_name, max(CASE WHEN c = 1 THEN name END) AS pr_name
FROM (SELECT batch, name, row_number() OVER (PARTITION BY batch ORDER BY fn DESC, name) AS a, row_number() OVER (PARTITION BY batch ORDER BY fp DESC, name) AS b, row_number() OVER (PARTITION BY batch ORDER BY positives / rows DESC, name) AS c
      FROM (SELECT *, segment || '=' || value AS name FROM mseg WHERE enough)) GROUP BY batch

-- view mscore
SELECT batch, feature, round(2 * max(k) + max(excess) + 0 + CASE WHEN max(max(ch)) OVER (PARTITION BY batch) > 0 THEN max(ch) / max(max(ch)) OVER (PARTITION BY batch) ELSE 0 END, 9) AS driver_score
FROM (SELECT f.batch, f.feature, CASE severity WHEN 'critical' THEN 2 ELSE 1 END AS k, least(greatest((value - warning_limit) / greatest(abs(critical_limit - warning_limit), 1e-9::DOUBLE), 0), 5) AS excess, coalesce(round(imp.absolute_change, 9), 0) AS ch
      FROM mfull f LEFT JOIN imp ON imp.batch = f.batch AND imp.feature = f.feature WHERE severity <> 'healthy') GROUP BY batch, feature

-- view mdrivers
SELECT batch, feature FROM mscore QUALIFY row_number() OVER (PARTITION BY batch ORDER BY driver_score DESC, feature) = 1

-- query investigation_records
SELECT 'production' AS stream, b.batch, label_status, action,
       coalesce(nullif(concat_ws(', ', CASE WHEN gaps THEN 'data_quality_failure' END, CASE WHEN moved THEN 'covariate_drift' END, CASE WHEN prediction_severity <> 'healthy' THEN 'prediction_drift' END,
                CASE WHEN p THEN 'prevalence_shift' END, CASE WHEN c THEN 'calibration_drift' END, CASE WHEN q THEN 'confirmed_performance_degradation' END), ''), 'monitoring_signal') AS classification,
       d.feature AS likely_driver, fn_name AS top_false_negative_segment, fp_name AS top_false_positive_segment, pr_name AS top_prevalence_segment, action_evidence AS recommended_action
FROM bacted b LEFT JOIN (SELECT batch, bool_or(metric = 'missingness_shift') AS gaps, bool_or(metric <> 'missingness_shift') AS moved FROM mfull WHERE severity <> 'healthy' GROUP BY batch) a ON a.batch = b.batch
LEFT JOIN failures ON failures.batch = b.batch LEFT JOIN mdrivers d ON d.batch = b.batch LEFT JOIN mtop ON mtop.batch = b.batch
WHERE NOT (drift_severity = 'healthy' AND performance_severity IN ('healthy', 'unavailable'))

-- query dataset_summary
SELECT dataset_period AS period, count(*) AS rows, min(t) AS minimum_time, max(t) AS maximum_time, round(avg(CAST(region IS NOT NULL AS DOUBLE)), 6) AS identity_coverage, round(avg(CAST(label AS DOUBLE)), 6) AS prevalence
FROM lab GROUP BY ROLLUP (dataset_period)

-- query missing_families
SELECT CAST(region IS NULL AS INTEGER) + CAST(CASE WHEN user_id % 5 <> 0 THEN channel END IS NULL AS INTEGER) AS missing_count_identity, CAST(v IS NULL AS INTEGER) AS missing_count_vendor,
       3 * CAST(amount IS NULL AS INTEGER) + CAST(user_id IS NULL AS INTEGER) + CAST(product IS NULL AS INTEGER) + CAST(score IS NULL AS INTEGER) + CAST(v IS NULL AS INTEGER)
       + 2 * CAST(m IS NULL AS INTEGER) + CAST(CASE WHEN m <> 0 THEN amount END IS NULL AS INTEGER) AS missing_count_transaction, count(*) AS rows
FROM (SELECT *, CASE WHEN event_id % 7 <> 0 THEN amount END AS v, sum(coalesce(amount, 0)) OVER w / nullif(count(*) OVER w, 0) AS m
      FROM txn WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY ALL

-- query drift_chart
SELECT batch, place, feature, metric, unnest(['value', 'warning_limit', 'critical_limit']) AS series, unnest([value, warning_limit, critical_limit]) AS metric_value
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY batch ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, value DESC NULLS LAST, feature, metric) AS INTEGER) AS place
      FROM (SELECT batch, feature, metric, severity, round(value, 6) AS value, round(warning_limit, 6) AS warning_limit, round(critical_limit, 6) AS critical_limit FROM mfull)) WHERE place <= 12

-- query overview
SELECT CASE WHEN stale > 0 THEN 'Stale' WHEN pending > 0 THEN pending || ' pending' ELSE 'Current' END AS freshness, CASE WHEN stale > 0 THEN 'investigate' ELSE latest_action END AS current_action, latest_batch, round(x.review_rate, 6) AS review_rate,
       o.batch AS mature_batch, round(o.prevalence, 6) AS prevalence, round(o.pr_auc, 6) AS pr_auc, round(o.recall, 6) AS recall, round(o.expected_calibration_error, 6) AS expected_calibration_error
FROM (SELECT count(*) FILTER (WHERE label_status = 'stale') AS stale, count(*) FILTER (WHERE label_status = 'pending') AS pending, arg_max(action, a.batch) AS latest_action, max(a.batch) AS latest_batch,
             arg_max(w.review_rate, a.batch) AS review_rate, max(a.batch) FILTER (WHERE label_status = 'mature') AS known FROM acted a JOIN wrow w ON w.batch = a.batch) x LEFT JOIN wrow o ON o.batch = known

-- query reported_segments
SELECT seg.batch, CAST(row_number() OVER (PARTITION BY seg.batch ORDER BY fn DESC, segment, value) AS INTEGER) AS place, segment, value, seg.rows, round(positives / seg.rows, 6) AS prevalence, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, CAST(fp AS DOUBLE) AS false_positive, CAST(fn AS DOUBLE) AS false_negative, CASE WHEN fa > 0 THEN round(ca / fa, 6) END AS captured_rate
FROM seg JOIN bm ON bm.batch = seg.batch WHERE enough AND NOT (drift_severity = 'healthy' AND performance_severity IN ('healthy', 'unavailable'))

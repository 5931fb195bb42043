"""Registered queries: losses, decisions and summaries over logs (the events and embeddings stand in for them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import arrays as A
from dialoom.operators import scoring, vocab
from dialoom.plans import base
from dialoom.plans.base import load, scratch, sql
from dialoom.plans.registry import query
from dialoom.sources import io

P = ("p", "SELECT *, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-logit)))) AS g FROM gates")
ENTROPY = "-(g * ln(g) + (1 - g) * ln(1 - g))"


@query(sql("steps", "SELECT CAST(step AS BIGINT) AS step, count(*) AS n, round(avg(CASE WHEN len(list_filter(t, lambda x: x <> 0)) > 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT step, CASE WHEN conv_id % 3 = 0 THEN [0, 0] WHEN conv_id % 3 = 1 AND step = 2 THEN [] ELSE target END AS t FROM steps) GROUP BY 1"))
def a15_supervised_share(spark, sf_dir):
    """Targets of some dialogues are padding alone, or empty."""
    c = F.col("conv_id") % 3
    target = F.when(c == 0, F.array(F.lit(0), F.lit(0))).when((c == 1) & (F.col("step") == 2), F.array().cast("array<int>")).otherwise(F.col("target"))
    return scoring.supervised_share(base.steps(spark, sf_dir).withColumn("target", target)).select(F.col("step").cast("long"), "n", "share")


@query(sql("gates", "SELECT split, round(sum(loss) / count(loss), 6) AS avg_loss, count(loss) AS steps FROM gates GROUP BY split"))
def a16_mean_loss(spark, sf_dir):
    return scoring.mean_loss(base.gates(spark, sf_dir), "split")


@query(sql("gates", "SELECT split, component, round(avg(v), 6) AS mean FROM (SELECT split, 'ce' AS component, loss AS v FROM gates UNION ALL SELECT split, 'bce', logit FROM gates) GROUP BY 1, 2"))
def a17_component_means(spark, sf_dir):
    log = base.gates(spark, sf_dir).withColumn("comps", F.create_map(F.lit("ce"), "loss", F.lit("bce"), "logit"))
    return scoring.component_means(log, "split")


@query(sql("gates", f"SELECT split, round(avg(g), 6) AS gate_mean, round(avg({ENTROPY}), 6) AS gate_entropy FROM p GROUP BY split", P))
def a18_gate_entropy(spark, sf_dir):
    return scoring.gate_summary(base.gates(spark, sf_dir), "split")


LOG = ("log", "SELECT *, total_steps // 100 AS epoch FROM gates")


@query(sql("gates", "SELECT CAST(epoch AS BIGINT) AS epoch, split, round(avg(loss), 6) AS avg_loss, min(loss) AS min_loss, count(*) AS n, arg_min(total_steps, (loss, total_steps)) AS best_step FROM log GROUP BY 1, 2", LOG))
def a19_metric_summary(spark, sf_dir):
    log = base.gates(spark, sf_dir).withColumn("epoch", F.floor(F.col("total_steps") / 100))
    return scoring.metric_summary(log)


@query(sql("gates", "SELECT CAST(total_steps // 1000 AS INTEGER) AS epoch, total_steps, loss AS avg_step_loss, split FROM gates"))
def s8_metrics_file(spark, sf_dir):
    """The metrics log written as CSV, with empty cells, and read back."""
    path = scratch(spark, "metrics")
    none = F.lit(None).cast("double")
    io.write_metrics(base.gates(spark, sf_dir).select(F.floor(F.col("total_steps") / 1000).cast("int").alias("epoch"), "total_steps", F.col("loss").alias("avg_step_loss"), none.alias("lr"), none.alias("gate_mean"), none.alias("token_ce"), none.alias("gate_bce"), none.alias("think_nce"), "split"), path)
    return io.read_metrics(spark, path).where("lr is null").select("epoch", "total_steps", "avg_step_loss", "split")


@query(sql("gates", "SELECT conv_id AS step, CAST(t AS INTEGER) AS t, round(1 / (1 + exp(-logit)), 4) AS gate_p, CAST(conv_id % 97 AS INTEGER) AS best, 0.25::DOUBLE AS best_p FROM gates"))
def s10_thinking_log(spark, sf_dir):
    """Trace lines written as text, read and parsed."""
    path = scratch(spark, "trace")
    g = base.gates(spark, sf_dir).select("conv_id", "t", F.round(1 / (1 + F.exp(-F.col("logit"))), 4).alias("p"))
    g.select(F.concat(F.lit("step="), "conv_id", F.lit(", t="), "t", F.lit(", gate_p="), F.format_string("%.4f", "p"), F.lit(", top2: "), F.col("conv_id") % 97, F.lit(":0.25, 5:0.125")).alias("value")).write.text(path)
    return io.parse_thinking(spark.read.text(path)).select("step", "t", "gate_p", F.col("topk")[0]["id"].alias("best"), F.col("topk")[0]["p"].alias("best_p"))


@query(sql("gates", "SELECT CAST(conv_id // 50 AS INTEGER) AS chunk, CAST((t - 1) // 500 AS INTEGER) AS steps, conv_id || '/' || t AS t, round(logit, 6) AS loss, CAST(conv_id % 97 AS INTEGER) AS best FROM gates"))
def s9_step_traces(spark, sf_dir):
    """All events as step traces, a JSON document for fifty users and 500 steps, read back with its name's numbers."""
    c, t = F.col("conv_id"), F.col("t")
    record = F.struct(F.concat(c.cast("string"), F.lit("/"), t.cast("string")).alias("t"), F.round("logit", 6).alias("loss"), F.array(F.array((c % 97).cast("double"), F.lit(0.5))).alias("topk"))
    path = scratch(spark, "dump")
    io.write_traces(base.gates(spark, sf_dir).select(F.floor(c / 50).alias("chunk"), F.floor((t - 1) / 500).alias("steps"), record.alias("record")), path)
    return io.read_traces(spark, path).select("chunk", "steps", "t", "loss", F.col("topk")[0]["id"].alias("best"))


@query(sql("gates", "SELECT split, total_steps, min(loss) OVER w AS best_before, coalesce(loss < min(loss) OVER w, true) AS new_best FROM gates WINDOW w AS (PARTITION BY split ORDER BY total_steps ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def w9_best_so_far(spark, sf_dir):
    return scoring.best_so_far(base.gates(spark, sf_dir), "split").select("split", "total_steps", "best_before", "new_best")


@query(sql("gates", "SELECT conv_id, arg_min(t, t) AS t, arg_min(g <= 0.7, t) AS forced FROM (SELECT *, least(count(*) OVER (PARTITION BY conv_id), 12) AS cap FROM p) WHERE t <= cap AND ((t >= 3 AND g > 0.7) OR t = cap) GROUP BY conv_id", P))
def e1_speak_decision(spark, sf_dir):
    log = base.gates(spark, sf_dir).withColumn("gate", A.guarded_gate(F.col("logit")))
    return scoring.speak_step(log, 0.7, 3, 12)


@query(sql("gates vocab", "SELECT s.conv_id, s.t, s.forced, s.token, CASE WHEN s.token = 2 THEN '' WHEN s.token = 3 THEN 'UNK' ELSE coalesce(v.word, '<UNK>') END AS answer FROM (SELECT conv_id, arg_min(t, t) AS t, arg_min(g <= 0.7, t) AS forced, arg_min((conv_id * 31 + t * 7) % 9 * CASE WHEN conv_id % 10 = 0 THEN 100000 ELSE 1 END + 2, t) AS token FROM (SELECT *, least(count(*) OVER (PARTITION BY conv_id), 12) AS cap FROM p) WHERE t <= cap AND ((t >= 3 AND g > 0.7) OR t = cap) GROUP BY conv_id) s LEFT JOIN vocab v ON v.idx = s.token", P))
def e1_answer_token(spark, sf_dir):
    """The word at the step that speaks: end marks are empty, and some ids are beyond the vocabulary."""
    c, t = F.col("conv_id"), F.col("t")
    token = (c * 31 + t * 7) % 9 * F.when(c % 10 == 0, 100_000).otherwise(1) + 2
    log = base.gates(spark, sf_dir).withColumns({"gate": A.guarded_gate(F.col("logit")), "token": token})
    return scoring.answers(log, 0.7, 3, 12, vocab.decode_table(base.vocabulary(spark, sf_dir)))


@query(sql("gates", "SELECT CAST(batch AS BIGINT) AS batch, min(t) AS t FROM (SELECT conv_id % 20 AS batch, t - 1 AS t, avg(g) AS m FROM p GROUP BY 1, 2) WHERE (t + 1 >= 2 AND m >= greatest(0, least(1, 0.6 - 0.1 * (t + 1) / 10))) OR t + 1 >= 10 OR t + 1 = 8 GROUP BY 1", P))
def e2_f14_batch_decision(spark, sf_dir):
    log = base.gates(spark, sf_dir).select((F.col("conv_id") % 20).alias("batch"), (F.col("t") - 1).alias("t"), "logit")
    return scoring.batch_speak_step(log, A.gate_threshold(F.col("t"), 0.6, 0.1, F.lit(10)), 2, 10, 8)


@query(sql("gates", "SELECT split, round(avg(CASE WHEN total_steps % 2 = 0 THEN 1.2 * (greatest(-logit, 0) + ln(1 + exp(-abs(logit)))) ELSE greatest(logit, 0) + ln(1 + exp(-abs(logit))) END), 6) AS bce FROM gates GROUP BY split"))
def e3_gate_bce(spark, sf_dir):
    log = base.gates(spark, sf_dir)
    y = F.when(F.col("total_steps") % 2 == 0, 1.0).otherwise(0.0)
    return log.groupBy("split").agg(F.round(F.avg(scoring.gate_bce(F.col("logit"), y)), 6).alias("bce"))


CE = ("ce", "SELECT *, ln(list_sum(list_transform(x, lambda v: exp(v - m)))) + m AS lse FROM (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x, list_max(embedding)::DOUBLE AS m FROM embeddings)")
CE_SQL = "SELECT label, round(avg(CASE WHEN label <> 0 THEN 0.95 * (lse - x[label + 1]) + 0.05 * (lse - list_sum(x) / len(x)) END), 5) AS ce FROM ce GROUP BY label"


@query(sql("", CE_SQL, CE))
def e4_token_ce(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    return e.groupBy("label").agg(F.round(F.avg(scoring.token_ce(F.col("x"), F.col("label"))), 5).alias("ce"))


@query(sql("", CE_SQL, CE))
def e4_token_ce_wide(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("key"), F.col("embedding").cast("array<double>").alias("logits"), "label")
    return e.select("key", "label").join(scoring.token_ce_wide(e), "key").groupBy("label").agg(F.round(F.avg("ce"), 5).alias("ce"))


SEQUENCES = ("seq", "SELECT vec_id, p, list_transform(embedding[8 * p + 1 : 8 * p + 8], lambda v: v::DOUBLE) AS x, CASE WHEN vec_id % 7 = 0 THEN 0 WHEN vec_id % 5 = 0 THEN 1 + label % 7 ELSE (label + 3 * p + vec_id) % 8 END AS y FROM embeddings, range(8) AS r(p) WHERE p < 3 + vec_id % 8 OR vec_id % 5 = 0")
POSITIONS = ("pos", "SELECT vec_id, p, 0.95 * (lse - x[y + 1]) + 0.05 * (lse - list_sum(x) / 8) AS ce FROM (SELECT *, ln(list_sum(list_transform(x, lambda v: exp(v)))) AS lse FROM seq) WHERE y <> 0")


@query(sql("", "SELECT CAST(vec_id AS BIGINT) AS vec_id, round(CASE WHEN vec_id % 11 = 0 AND bool_or(p = 0) THEN 0 ELSE coalesce(avg(ce), 0) END, 5)::DOUBLE AS ce, count(ce) AS positions FROM (SELECT DISTINCT vec_id FROM embeddings) LEFT JOIN pos USING (vec_id) GROUP BY vec_id", SEQUENCES, POSITIONS))
def e4_token_ce_sequences(spark, sf_dir):
    """Eight positions of eight logits, against targets of three to ten ids, of padding alone, of one id, and with NaN
    or an infinite value among the first position's logits, which counts where that position does."""
    i, label = F.col("vec_id"), F.col("label")
    x = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.slice(F.col("embedding").cast("array<double>"), p * 8 + 1, F.lit(8)))
    spoilt = F.when(i % 11 == 0, F.transform(x, lambda v, p: F.when(p == 0, F.array_append(F.slice(v, 1, 7), F.when(i % 2 == 0, float("nan")).otherwise(float("inf")))).otherwise(v))).otherwise(x)
    ids = F.transform(F.sequence(F.lit(0).cast("long"), 2 + i % 8), lambda p: F.when(i % 7 == 0, 0).otherwise((label + 3 * p + i) % 8))
    target = F.when((i % 5 == 0) & (i % 7 != 0), F.array(1 + label % 7)).otherwise(ids)
    rows = load(spark, sf_dir, "embeddings").select(i.cast("long").alias("vec_id"), spoilt.alias("logits"), target.cast("array<int>").alias("target"))
    out = scoring.token_ce_sequences(rows, "vec_id")
    return out.select("vec_id", F.round("ce", 5).alias("ce"), "positions")


@query(sql("gates", f"SELECT split, round(avg({ENTROPY}), 6) AS entropy, round(abs(avg(g) - 0.15), 6) AS budget FROM p GROUP BY split", P))
def e5_entropy_budget(spark, sf_dir):
    return scoring.entropy_and_budget(base.gates(spark, sf_dir), "split")


NCE = ("v", "SELECT vec_id // 8 AS b, vec_id % 8 AS r, list_transform(embedding, lambda q: q::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z::DOUBLE)))) AS u FROM embeddings")


NCE_BATCHES = (NCE[0], NCE[1].replace("// 8", "// 256").replace("% 8", "% 256"))


def _nce(spark, sf_dir, size: int = 8):
    """h_prev is a row's vector, h_next the next one's of its batch, wrapping."""
    from pyspark.sql import Window

    w = Window.partitionBy("batch_no").orderBy("row")
    e = load(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / size).alias("batch_no"), (F.col("vec_id") % size).alias("row"), F.col("embedding").alias("h_prev"))
    return scoring.info_nce(e.withColumn("h_next", F.coalesce(F.lead("h_prev").over(w), F.first("h_prev").over(w))))


@query(sql("", "SELECT CAST(b AS BIGINT) AS batch_no, round(avg(ce), 3) AS nce FROM (SELECT n.b, n.r, ln(sum(exp(s))) - sum(s) FILTER (c = r) AS ce FROM (SELECT x.b, x.r, y.r AS c, list_dot_product(z.u, y.u) / 0.1 AS s FROM v x JOIN v y ON x.b = y.b JOIN (SELECT b, count(*) AS k FROM v GROUP BY 1) k ON k.b = x.b JOIN v z ON z.b = x.b AND z.r = (x.r + 1) % k.k) n GROUP BY 1, 2) GROUP BY 1", NCE))
def e6_info_nce(spark, sf_dir):
    return _nce(spark, sf_dir).select("batch_no", F.round("nce", 3).alias("nce"))


@query(sql("", "SELECT CAST(b AS BIGINT) AS batch_no, round(avg(ce), 6) AS nce FROM (SELECT n.b, n.r, ln(sum(exp(s))) - sum(s) FILTER (c = r) AS ce FROM (SELECT x.b, x.r, y.r AS c, list_dot_product(z.u, y.u) / 0.1 AS s FROM v x JOIN v y ON x.b = y.b JOIN (SELECT b, count(*) AS k FROM v GROUP BY 1) k ON k.b = x.b JOIN v z ON z.b = x.b AND z.r = (x.r + 1) % k.k) n GROUP BY 1, 2) GROUP BY 1", NCE_BATCHES))
def e6_info_nce_batches(spark, sf_dir):
    """Batches of 256, to six decimals."""
    return _nce(spark, sf_dir, 256).select("batch_no", F.round("nce", 6).alias("nce"))


@query(sql("gates", f"SELECT split, round(avg(greatest(logit, 0) + ln(1 + exp(-abs(logit)))) + 0.01 * avg({ENTROPY}) + 0.1 * abs(avg(g) - 0.15) + avg(loss) + 0.1 * avg(abs(logit)), 6) AS total FROM p GROUP BY split", P))
def e7_total_loss(spark, sf_dir):
    """Gate loss with target 0, entropy, budget, and the log's values as token and contrastive losses."""
    log, p = base.gates(spark, sf_dir), A.guarded_gate(F.col("logit"))
    total = scoring.total_loss(F.avg(scoring.gate_bce(F.col("logit"), F.lit(0.0))), F.avg("loss"), F.avg(A.entropy(p)), F.abs(F.avg(p) - scoring.RATIO), F.avg(F.abs("logit")))
    return log.groupBy("split").agg(F.round(total, 6).alias("total"))


@query(sql("gates", "SELECT count(*) FILTER (total_steps % 10 = 0) AS loss_replaced, round(sum(CASE WHEN total_steps % 10 = 0 THEN 0 ELSE loss END), 6) AS loss_sum FROM gates"))
def e8_replaced_values(spark, sf_dir):
    log = base.gates(spark, sf_dir).withColumn("loss", F.when(F.col("total_steps") % 10 == 0, float("nan")).otherwise(F.col("loss")))
    return scoring.replaced(log, "loss")


@query("SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(len(embedding)), lambda i: {'p': -embedding[i + 1], 'i': i}))[1:5], lambda s: s.i::VARCHAR), ' ') AS top, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS best FROM embeddings")
def t4_top_k(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.array_join(F.transform(A.top_k(F.col("embedding"), 5), lambda x: x["id"].cast("string")), " ").alias("top"), A.arg_max(F.col("embedding")).alias("best"))


@query("SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(len(embedding)), lambda i: {'p': -round(embedding[i + 1]::DOUBLE * 4), 'i': i}))[1:9], lambda s: s.i || ':' || CAST(-s.p AS BIGINT)), ' ') AS top FROM embeddings")
def t4_top_k_wide(spark, sf_dir):
    """Values rounded so that many tie."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 4)).alias("values"))
    return scoring.top_k_wide(e, 9).select("vec_id", F.array_join(F.transform("top", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["p"].cast("long").cast("string"))), " ").alias("top"))


@query("SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(len(embedding)), lambda i: {'p': -embedding[i + 1], 'i': i}))[1:3], lambda s: 'w' || s.i || ':' || printf('%.4f', (-s.p)::DOUBLE)), ' ') AS line FROM embeddings")
def f17_rendering(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.array_join(F.transform(A.top_k(F.col("embedding"), 3), lambda x: F.concat(F.format_string("w%d:", x["id"]), A.fixed(x["p"], 4))), " ").alias("line"))


@query(sql("gates", "SELECT conv_id, t, round(greatest(1.5 * pow(0.95, t), 0.2), 6) AS temperature, round(pow(0.95, t), 6) AS lr, round((t + 1) / 40, 6) AS t_norm FROM gates"))
def f13_schedule(spark, sf_dir):
    t = F.col("t")
    return base.gates(spark, sf_dir).select("conv_id", "t", F.round(A.temperature(t), 6).alias("temperature"), F.round(A.lr_factor(t), 6).alias("lr"), F.round((t + 1) / 40, 6).alias("t_norm"))


@query(sql("gates", "SELECT conv_id, t, round((t + 1) / greatest(cap + 2.5, 1), 6) AS t_norm, round(greatest(greatest(cap + 2.5, 1) - (t + 1), 0) / greatest(cap + 2.5, 1), 6) AS remain_norm, CASE WHEN t + 1 >= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS min_done, 0.15::DOUBLE AS budget, round((t + 1) / greatest(cap, 1), 6) AS plain, 1.0::DOUBLE AS always FROM (SELECT *, conv_id % 40 AS cap FROM gates)"))
def f13_control(spark, sf_dir):
    """Control values of plans of 0 to 39 steps: in training with 2.5 more steps, and in evaluation."""
    t, cap = F.col("t"), F.col("conv_id") % 40
    ramp, plain = A.control(t, cap, least=3, extra=2.5), A.control(t, cap)
    return base.gates(spark, sf_dir).select("conv_id", "t", F.round(ramp["t_norm"], 6).alias("t_norm"), F.round(ramp["remain_norm"], 6).alias("remain_norm"), ramp["min_done"].alias("min_done"), ramp["budget"].alias("budget"), F.round(plain["t_norm"], 6).alias("plain"), plain["min_done"].alias("always"))


@query(sql("vocab", "SELECT vec_id, string_agg(coalesce(word, '<UNK>') || ':' || printf('%.6f', p), ' ' ORDER BY p DESC, id) AS line FROM (SELECT vec_id, unnest(list_sort(list_transform(range(len(embedding)), lambda i: {'n': -embedding[i + 1]::DOUBLE, 'i': i}))[1:5], recursive := true) FROM embeddings) t(vec_id, n, id), LATERAL (SELECT -n AS p) LEFT JOIN vocab ON idx = id * 40 GROUP BY vec_id"))
def f17_top_words(spark, sf_dir):
    """The five largest values of each row with their words, `word:0.123456`."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(A.top_k(F.col("embedding"), 5)).alias("rank", "x"))
    words = e.join(F.broadcast(base.vocabulary(spark, sf_dir).select("word", "idx")), F.col("x.id") * 40 == F.col("idx"), "left")
    top = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("word", F.lit("<UNK>")).alias("word"), F.col("x.p").alias("p"))))
    return words.groupBy("vec_id").agg(A.rendered_top(top).alias("line"))


@query(sql("gates", "SELECT conv_id, t, CASE WHEN total_steps % 4 = 0 THEN 0.0 WHEN total_steps % 4 = 1 THEN 1.0 WHEN total_steps % 4 = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS gate, total_steps % 4 = 3 AS junk FROM gates"))
def f16_gate_values(spark, sf_dir):
    """Gates as '', '1', true and text that is no number."""
    k = F.col("total_steps") % 4
    g = base.gates(spark, sf_dir)
    one = F.when(k == 0, '""').when(k == 1, '"1"').when(k == 2, "true").otherwise('"abc"')
    lines = g.select(F.lit("train").alias("split"), F.lit(0).alias("split_ord"), F.col("total_steps").alias("line_no"), F.concat(F.lit('[{"gate_signal":'), one, F.lit("}]")).alias("value"))
    return io.elements(lines).join(g.select(F.col("total_steps").alias("conv_id"), F.col("conv_id").alias("user"), "t"), "conv_id").select(F.col("user").alias("conv_id"), "t", "gate", "junk")

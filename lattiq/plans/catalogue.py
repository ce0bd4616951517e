"""Registered queries of the engine's operators and the same results as DuckDB SQL.

The test index: passages are runs of five rows of ``embeddings``, the codebook is ``residual_codec``, residuals are
coded with 4 bits over all rows, and the queries are all rows whose id is divisible by 20, four tokens to a query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lattiq.functions import codec, kernels
from lattiq.operators import build, evaluate, maintain, predicates, search
from lattiq.operators.search import Parameters
from lattiq.plans.parameters import device_ratios

MAIN = Parameters(nprobe=6, bound=24, threshold=0.0, t_prime=60)
STRICT = Parameters(nprobe=6, bound=24, threshold=0.3, t_prime=60)
K = 10
NBITS = 4


class Fixture:
    """Frames of the test index over one data folder."""

    def __init__(self, spark, d):
        self.spark = spark
        self.table = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
        self.rows = spark.read.parquet(f"{d}/embeddings.parquet")
        wide = "transform({0}, x -> cast(x as double))"
        self.tokens = self.rows.selectExpr("vec_id div 5 as pid", "cast(vec_id % 5 as int) as pos", f"{wide.format('embedding')} as vec", "label")
        self.centroids = spark.read.parquet(f"{d}/residual_codec.parquet").selectExpr("cid", f"{wide.format('centroids')} as vec")
        self.queries = self.rows.where("vec_id % 20 = 0").selectExpr("vec_id div 80 as qid", "cast((vec_id div 20) % 4 as int) as tok", f"{wide.format('embedding')} as vec", "label")

    @property
    def assigned(self):
        return kernels.nearest_centroid(self.tokens, self.centroids)

    @property
    def sizes(self):
        return build.histogram(self.assigned, self.centroids)

    @property
    def quantiles(self):
        return build.bucket_quantiles(self.assigned, NBITS)

    @property
    def codes(self):
        """Assigned tokens with codes; the codec is one row."""
        return self.assigned.crossJoin(F.broadcast(self.quantiles)).withColumn("codes", F.expr(codec.sql_bucketize("residual", "cutoffs")))

    def picked(self, p):
        scores = kernels.centroid_scores(search.live_tokens(self.queries), self.centroids, p.bound)
        return search.selected(scores, self.sizes, p)

    def scored(self, p, subset=None, postings=None):
        picked = self.picked(p)
        cells = search.probes(picked, self.queries, self.sizes, p)
        postings = self.codes.select("cid", "pid", "codes", "weights") if postings is None else postings
        if subset is not None and "qid" not in subset.columns:
            postings = search.only(postings, subset)
        hits = search.fetch(cells, postings)
        if subset is not None and "qid" in subset.columns:
            hits = search.only(hits, subset)
        return picked, search.residual_scores(hits, self.queries, "weights")

    def totals(self, p, **kw):
        picked, scored = self.scored(p, **kw)
        # a weak token has the estimate 0
        estimates = self.queries.select("qid", "tok").join(search.missing_estimates(picked, p), ["qid", "tok"], "left").na.fill(0.0, ["m"])
        return search.merge_sum(search.merge_max(scored), estimates)

    def result(self, p, **kw):
        return search.top_k(self.totals(p, **kw), K)

    def exact(self):
        return search.top_k(search.max_sim(self.queries, self.tokens), K)

    @property
    def base(self):
        """Postings before an addition: passages whose number is not divisible by 3; the others are new."""
        return self.assigned.select("cid", "pid", "pos", F.lit(0).alias("gen"))

    @property
    def qrels(self):
        """Artificial judgements: a passage is relevant if its first token has the label of the query's first."""
        a = self.queries.where("tok = 0").select("qid", "label")
        return a.join(self.tokens.where("pos = 0").select("pid", "label"), "label").selectExpr("qid", "pid as doc_id", "1 as rel")

    def run(self):
        return self.result(MAIN).selectExpr("qid", "pid as doc_id", "score")


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, d: f(Fixture(spark, d))
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


_DOT = "list_inner_product({0}, {1})"
_TOK = """tok as (select vec_id // 5 as pid, cast(vec_id % 5 as int) as pos, embedding::double[] as vec, label from embeddings),
cen as (select cid, centroids::double[] as vec from residual_codec),
q as (select vec_id // 80 as qid, cast((vec_id // 20) % 4 as int) as tok, embedding::double[] as vec, label from embeddings where vec_id % 20 = 0)"""
_ASG = f"""{_TOK},
sc as (select t.pid, t.pos, t.vec, c.cid, c.vec as cvec, list_inner_product(t.vec, c.vec) as score from tok t, cen c),
asg as materialized (select pid, pos, vec, cid, score, list_transform(range(1, 65), lambda i: vec[i] - cvec[i]) as residual
  from (select *, row_number() over (partition by pid, pos order by score desc, cid) as rn from sc) where rn = 1),
sz as (select c.cid, count(a.pid) as size from cen c left join asg a on a.cid = c.cid group by c.cid)"""
_CUT = "[" + ", ".join(str(i / 16) for i in range(1, 16)) + "]"
_MID = "[" + ", ".join(str((i + 0.5) / 16) for i in range(16)) + "]"
_CODE = f"""{_ASG},
val as (select unnest(residual) as x from asg),
qu as materialized (select quantile_cont(x, {_CUT}) as cutoffs, quantile_cont(x, {_MID}) as weights from val),
code as materialized (select asg.*, weights, list_transform(residual, lambda x: len(list_filter(cutoffs, lambda c: c < x))) as codes from asg, qu)"""


def _pick(p: Parameters) -> str:
    return f"""{_ASG},
cs as (select q.qid, q.tok, c.cid, list_inner_product(q.vec, c.vec) as score from q, cen c where len(list_filter(q.vec, lambda x: x <> 0)) > 0),
rk as (select *, max(score) over (partition by qid, tok) as best, row_number() over (partition by qid, tok order by score desc, cid) as rn from cs),
pk as (select rk.qid, rk.tok, rk.cid, rk.score, rk.rn, sz.size, sum(sz.size) over (partition by rk.qid, rk.tok order by rk.rn rows unbounded preceding) as cum
  from rk join sz on sz.cid = rk.cid where best >= {p.threshold} and rn <= {p.bound}),
mi as (select qid, tok, least(count(*) filter (cum < {p.t_prime}), {p.bound - 1}) + 1 as at from pk group by qid, tok),
me as (select pk.qid, pk.tok, pk.score as m from pk join mi on mi.qid = pk.qid and mi.tok = pk.tok and mi.at = pk.rn),
kd as (select cid as kd from sz order by size, cid limit 1),
pr as (select qid, tok, case when score = 0 then kd else cid end as cid, score from pk, kd where rn <= {p.nprobe}
  union all select q.qid, q.tok, kd, 0.0 from q, kd where not exists (select 1 from pk where pk.qid = q.qid and pk.tok = q.tok))"""


def _search(p: Parameters, keep: str = "true", post: str = "true", code: str = "code") -> str:
    body = _pick(p).replace(_ASG, _CODE)
    return f"""{body},
hit as (select pr.qid, pr.tok, pr.cid, c.pid, pr.score + list_sum(list_transform(range(1, 65), lambda i: q.vec[i] * c.weights[c.codes[i] + 1])) as score
  from pr join (select * from {code} where {post}) c on c.cid = pr.cid join q on q.qid = pr.qid and q.tok = pr.tok where {keep}),
mx as (select qid, tok, pid, max(score) as score from hit group by all),
em as (select q.qid, q.tok, coalesce(m, 0) as m from q left join me on me.qid = q.qid and me.tok = q.tok),
tot as (select mx.qid, mx.pid, sum(mx.score - em.m) + any_value(b.base) as score from mx join em on em.qid = mx.qid and em.tok = mx.tok
  join (select qid, sum(m) as base from em group by qid) b on b.qid = mx.qid group by mx.qid, mx.pid),
res as (select qid, cast(rank as int) as rank, pid, score from (select *, row_number() over (partition by qid order by score desc, pid) as rank from tot) where rank <= {K})"""


# sources and layout


@query(f"with {_TOK} select pid, pos, round(list_sum(vec), 6) as total from tok")
def token_rows(f):
    return f.tokens.selectExpr("pid", "pos", "round(aggregate(vec, 0D, (s, x) -> s + x), 6) as total")


@query(f"with {_TOK} select pid, count(*) as doclen from tok group by pid")
def doc_lengths(f):
    return build.doc_lengths(f.tokens)


@query(f"with {_TOK} select pid // 64 as chunk, count(*) as docs, cast(sum(n) as bigint) as tokens from (select pid, count(*) as n from tok group by pid) group by 1")
def chunk_assignment(f):
    return build.chunk_of(build.doc_lengths(f.tokens), 64).groupBy("chunk").agg(F.count(F.lit(1)).alias("docs"), F.sum("doclen").alias("tokens"))


@query(
    "select file_path as file, source_id, cast(i - 1 as int) as doc, cast(coalesce(list_sum(doclens[:i - 1]), 0) as bigint) as first_row, doclens[i] as n_rows from "
    "(select distinct file_path, source_id, doclens, unnest(range(1, len(doclens) + 1)) as i from embedding_files where doclens is not null)"
)
def doclens_split(f):
    files = f.table("embedding_files").selectExpr("struct(file_path, source_id) as file", "doclens").where("doclens is not null").distinct()
    return build.split_by_doclens(files).selectExpr("file.file_path as file", "file.source_id as source_id", "doc", "first_row", "n_rows")


# build


@query(f"with {_ASG} select pid, pos, cid, round(score, 6) as score from asg")
def centroid_assign(f):
    return f.assigned.select("pid", "pos", "cid", *r6("score"))


@query(f"with {_ASG} select cid, size from sz")
def centroid_hist(f):
    return f.sizes


@query(f"with {_ASG} select cid, size, cast(sum(size) over (order by cid) - size as bigint) as begin from sz")
def csr_offsets(f):
    return build.offsets(f.sizes)


@query(f"with {_ASG} select pid, pos, round(sqrt(list_inner_product(residual, residual)), 6) as norm from asg")
def residual_norms(f):
    return build.residual_norms(f.assigned).select("pid", "pos", *r6("norm"))


@query(f"with {_ASG} select round(quantile_disc(sqrt(list_inner_product(residual, residual)), 0.75), 6) as threshold from asg")
def cluster_threshold(f):
    return build.nearest_rank(build.residual_norms(f.assigned)).select(*r6("threshold"))


@query(f"with {_ASG} select round(quantile_cont(sqrt(list_inner_product(residual, residual)), 0.75), 6) as threshold from asg")
def cluster_threshold_linear(f):
    return build.linear_rank(build.residual_norms(f.assigned)).select(*r6("threshold"))


@query(f"with {_ASG} select cast(i - 1 as int) as dim, round(avg(abs(residual[i])), 6) as avg_abs from (select residual, unnest(range(1, 65)) as i from asg) group by i")
def avg_residual(f):
    return build.mean_abs_residual(f.assigned).select("dim", *r6("avg_abs"))


@query(f"with {_CODE} select cast(i - 1 as int) as bucket, round(cutoffs[i], 6) as cutoff from (select cutoffs, unnest(range(1, 16)) as i from qu)")
def bucket_cutoffs(f):
    return f.quantiles.select(F.posexplode("cutoffs").alias("bucket", "cutoff")).select("bucket", *r6("cutoff"))


@query(f"with {_CODE} select cast(i - 1 as int) as bucket, round(weights[i], 6) as weight from (select weights, unnest(range(1, 17)) as i from qu)")
def bucket_weights(f):
    return f.quantiles.select(F.posexplode("weights").alias("bucket", "weight")).select("bucket", *r6("weight"))


@query(f"with {_CODE} select cast(c as int) as code, count(*) as n from (select unnest(codes) as c from code) group by c")
def bucketize_hist(f):
    return f.codes.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


_REV4 = "((({0}) // 1 % 2) * 8 + (({0}) // 2 % 2) * 4 + (({0}) // 4 % 2) * 2 + (({0}) // 8 % 2))"
_REV2 = "((({0}) // 1 % 2) * 2 + (({0}) // 2 % 2))"


def _packed_sql(nbits: int) -> str:
    per, rev = 8 // nbits, _REV4 if nbits == 4 else _REV2
    code = "codes[i * {per} + {k}]" if nbits == 4 else "codes[i * {per} + {k}] // 4"
    parts = " + ".join(rev.format(code.format(per=per, k=k + 1)) + f" * {1 << (nbits * (per - 1 - k))}" for k in range(per))
    return f"with {_CODE}, b as (select pid, pos, unnest(range(0, {64 // per})) as i, codes from code) select pid, pos, cast(i as int) as byte_no, cast({parts} as int) as byte from b"


@query(_packed_sql(4))
def pack_codes4(f):
    return f.codes.selectExpr("pid", "pos", f"posexplode({codec.sql_pack('codes', 4)}) as (byte_no, byte)")


@query(_packed_sql(2))
def pack_codes2(f):
    return f.codes.selectExpr("pid", "pos", "transform(codes, c -> c div 4) as codes").selectExpr("pid", "pos", f"posexplode({codec.sql_pack('codes', 2)}) as (byte_no, byte)")


@query(f"with {_CODE} select pid, pos, cast(i as int) as dim, cast(codes[i + 1] as int) as code from (select pid, pos, codes, unnest(range(0, 64)) as i from code)")
def unpack_codes4(f):
    packed = f.codes.selectExpr("pid", "pos", f"{codec.sql_pack('codes', 4)} as bytes")
    return packed.selectExpr("pid", "pos", f"posexplode({codec.sql_unpack('bytes', 4)}) as (dim, code)")


# search


@query(f"with {_TOK} select qid, tok, c.cid, round(list_inner_product(q.vec, c.vec), 6) as score from q, cen c")
def centroid_scores(f):
    return kernels.centroid_scores(search.live_tokens(f.queries), f.centroids).select("qid", "tok", "cid", *r6("score"))


@query(f"with {_TOK} select qid, tok, round(max(list_inner_product(q.vec, c.vec)), 6) as best from q, cen c group by qid, tok having max(list_inner_product(q.vec, c.vec)) < {STRICT.threshold}")
def weak_tokens(f):
    return search.weak_tokens(kernels.centroid_scores(f.queries, f.centroids, 1), STRICT.threshold).select("qid", "tok", *r6("best"))


@query(f"with {_pick(MAIN)} select qid, tok, cid, cast(rn as int) as rn, round(score, 6) as score, cast(cum as bigint) as cum from pk")
def bound_cells(f):
    return f.picked(MAIN).select("qid", "tok", "cid", "rn", *r6("score"), "cum")


@query(f"with {_pick(MAIN)} select qid, tok, cid, round(score, 6) as score from pr")
def probe_cells(f):
    return search.probes(f.picked(MAIN), f.queries, f.sizes, MAIN).select("qid", "tok", "cid", *r6("score"))


@query(f"with {_pick(MAIN)} select qid, tok, round(m, 6) as m from me")
def mse_estimate(f):
    return search.missing_estimates(f.picked(MAIN), MAIN).select("qid", "tok", *r6("m"))


@query(f"with {_pick(STRICT)} select qid, tok, cid, round(score, 6) as score from pr")
def dummy_cells(f):
    return search.probes(f.picked(STRICT), f.queries, f.sizes, STRICT).select("qid", "tok", "cid", *r6("score"))


@query(f"with {_pick(MAIN)} select pr.qid, pr.tok, pr.cid, asg.pid, asg.pos from pr join asg on asg.cid = pr.cid")
def posting_fetch(f):
    cells = search.probes(f.picked(MAIN), f.queries, f.sizes, MAIN).select("qid", "tok", "cid")
    return search.fetch(cells, f.assigned.select("cid", "pid", "pos")).select("qid", "tok", "cid", "pid", "pos")


@query(f"with {_search(MAIN)} select qid, tok, cid, pid, round(score, 6) as score from hit")
def residual_scores(f):
    return f.scored(MAIN)[1].select("qid", "tok", "cid", "pid", *r6("score"))


@query(f"with {_search(MAIN)} select qid, tok, pid, round(score, 6) as score from mx")
def merge_max(f):
    return search.merge_max(f.scored(MAIN)[1]).select("qid", "tok", "pid", *r6("score"))


@query(f"with {_search(MAIN)} select qid, tok, pid, round(score, 6) as score from mx")
def kernel_scores(f):
    """The Arrow kernel over packed postings gives the scores of the SQL form."""
    return _kernel(f, MAIN).select("qid", "tok", "pid", *r6("score"))


def _kernel(f, p):
    import numpy as np

    from lattiq.plans.engine import probe_batch

    one = f.quantiles.first()  # one row
    postings = kernels.encode_tokens(f.assigned.select("cid", "pid", "residual"), np.array(one.cutoffs), NBITS)
    cells = search.probes(f.picked(p), f.queries, f.sizes, p)
    batch = probe_batch(cells, f.queries)
    return search.merge_max(kernels.score_postings(postings, batch, np.array(one.weights), NBITS))


@query(f"with {_search(MAIN)} select qid, pid, round(score, 6) as score from tot")
def merge_sum_fill(f):
    return f.totals(MAIN).select("qid", "pid", *r6("score"))


@query(f"with {_search(MAIN)} select qid, rank, pid, round(score, 6) as score from res")
def search_topk(f):
    return f.result(MAIN).select("qid", "rank", "pid", *r6("score"))


@query(f"with {_search(STRICT)} select qid, rank, pid, round(score, 6) as score from res")
def search_weak(f):
    return f.result(STRICT).select("qid", "rank", "pid", *r6("score"))


@query(f"with {_search(MAIN, post='pid % 2 = 0')} select qid, rank, pid, round(score, 6) as score from res")
def search_subset(f):
    subset = f.tokens.select("pid").distinct().where("pid % 2 = 0")
    return f.result(MAIN, subset=subset).select("qid", "rank", "pid", *r6("score"))


@query(f"with {_search(MAIN, keep='c.pid % 3 = pr.qid % 3')} select qid, rank, pid, round(score, 6) as score from res")
def search_subset_per_query(f):
    q = f.queries.selectExpr("qid", "qid % 3 as g").distinct()
    subset = q.join(f.tokens.selectExpr("pid", "pid % 3 as g").distinct(), "g").select("qid", "pid")
    return f.result(MAIN, subset=subset).select("qid", "rank", "pid", *r6("score"))


@query(f"with {_search(MAIN)} select qid, cast(rank as int) as rank, pid, round(score, 6) as score from (select *, row_number() over (partition by qid order by score desc, pid) as rank from tot where pid % 7 <> 0) where rank <= {K}")
def search_tombstones(f):
    gone = f.tokens.select("pid").distinct().where("pid % 7 = 0")
    return search.top_k(search.living(f.totals(MAIN), gone), K).select("qid", "rank", "pid", *r6("score"))


_EXACT = f"""{_TOK}, ex as (select q.qid, q.tok, t.pid, max(list_inner_product(q.vec, t.vec)) as s from q, tok t group by all),
et as (select qid, pid, sum(s) as score from ex group by qid, pid),
er as (select qid, cast(rank as int) as rank, pid, score from (select *, row_number() over (partition by qid order by score desc, pid) as rank from et) where rank <= {K})"""


@query(f"with {_EXACT} select qid, rank, pid, round(score, 6) as score from er")
def maxsim_exact(f):
    return f.exact().select("qid", "rank", "pid", *r6("score"))


@query(f"with {_search(MAIN)}, {_EXACT.replace(_TOK + ', ', '')} select qid, round(count(res.pid) / {K}.0, 6) as recall from er left join res using (qid, pid) group by qid")
def recall_vs_exact(f):
    got = f.result(MAIN).select("qid", "pid", F.lit(1).alias("hit"))
    return f.exact().join(got, ["qid", "pid"], "left").groupBy("qid").agg(F.round(F.count("hit") / K, 6).alias("recall"))


# mutation and maintenance


@query(f"with {_ASG}, g as (select cid, pid from asg where pid % 3 <> 0 union all select cid, pid from asg where pid % 3 = 0) select cid, count(*) as n, cast(sum(pid) as bigint) as pids from g group by cid")
def add_merge(f):
    merged = maintain.added(f.base.where("pid % 3 <> 0"), f.base.where("pid % 3 = 0"))
    return merged.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("pids"))


@query(f"with {_ASG} select cid, pid, pos from asg where pid % 10 <> 0 union all select t.cid, s.pid, s.pos from asg s join asg t on t.pid = s.pid + 1 and t.pos = s.pos where s.pid % 10 = 0")
def update_replace(f):
    base = f.base
    new = base.withColumn("pid", F.expr("pid - 1")).where("pid % 10 = 0 and pid >= 0").withColumn("gen", F.lit(1))
    return maintain.replaced(base, new).select("cid", "pid", "pos")


@query(f"with {_ASG} select cid, pid, pos from asg where pid % 7 <> 0")
def delete_compact(f):
    docs = f.base.select("pid", "gen").distinct().withColumn("deleted", F.lit(False))
    return maintain.compacted(f.base, maintain.delete(docs, docs.where("pid % 7 = 0"))).select("cid", "pid", "pos")


@query(f"with {_ASG} select cid, cast(row_number() over (order by cid) - 1 as int) as new_cid from sz where size > 0")
def prune_renumber(f):
    return build.prune_empty(f.centroids, f.assigned)


@query(f"with {_ASG}, n as (select pid, pos, sqrt(list_inner_product(residual, residual)) as norm from asg) select pid, pos, round(norm, 6) as norm from n where norm > 1.18")
def outlier_tokens(f):
    return maintain.outliers(build.residual_norms(f.assigned), 1.18).select("pid", "pos", *r6("norm"))


@query(
    f"with {_ASG}, n as (select pid, sqrt(list_inner_product(residual, residual)) as norm from asg), "
    "o as (select count(*) as c, quantile_disc(norm, 0.75) as t from n where pid % 3 <> 0), w as (select count(*) as c, quantile_cont(norm, 0.75) as t from n where pid % 3 = 0) "
    "select round((o.t * o.c + w.t * w.c) / (o.c + w.c), 6) as threshold from o, w"
)
def blend_threshold(f):
    norms = build.residual_norms(f.assigned)
    old = build.nearest_rank(norms.where("pid % 3 <> 0")).join(norms.where("pid % 3 <> 0").agg(F.count(F.lit(1)).alias("n")))
    new = build.linear_rank(norms.where("pid % 3 = 0")).join(norms.where("pid % 3 = 0").agg(F.count(F.lit(1)).alias("n")))
    both = old.unionByName(new)  # two rows
    return both.agg(F.round(F.sum(F.expr("threshold * n")) / F.sum("n"), 6).alias("threshold"))


@query(
    f"with {_ASG}, cu as (select cid, sum(size) over (order by cid) as cum, sum(size) over () as total from sz), n as (select count(*) as n, "
    "coalesce(min(case when cum >= ceil(0.5 * total) then cid end) + 1, count(*)) as e0, coalesce(min(case when cum >= ceil(0.8 * total) then cid end) + 1, count(*)) as e1 from cu) "
    "select 0 as shard, 0::bigint as first_cid, e0::bigint as end_cid from n union all select 1, e0, greatest(e0, e1) from n union all select 2, greatest(e0, e1), n from n"
)
def shard_boundaries(f):
    return build.shard_of(f.sizes, [0.5, 0.3, 0.2])


@query(f"with {_ASG}, n as (select (select count(*) from asg) as e, (select count(*) from cen) as c) select c * 64 * 4 as centroids, 64 as bucket_weights, e * 8 as pids, e * 32 as residuals, c * 16 + 8 as sizes_and_offsets, c * 64 * 4 + 64 + e * 40 + c * 16 + 8 as total from n")
def memory_estimate(f):
    est = maintain.memory_estimate(f.tokens.count(), f.centroids.count(), 64, NBITS)
    return f.spark.createDataFrame([tuple(est.values())], ", ".join(f"{k} bigint" for k in est)).withColumn("bucket_weights", F.col("bucket_weights").cast("int"))


@query(f"with {_ASG} select count(*) as num_embeddings, count(distinct pid) as num_passages, round(count(*) / count(distinct pid), 6) as avg_doclen from asg")
def meta_row(f):
    return build.statistics(f.assigned).select("num_embeddings", "num_passages", *r6("avg_doclen"))


@query("select 'cpu' as device, cast(1 as double) as ratio")
def device_map(f):
    return f.spark.createDataFrame(list(device_ratios(["cuda:0", "cpu"], 1).items()), "device string, ratio double")


# the engine itself: an index on disk with the given codebook and buckets, built, opened, searched and changed


def _engine(f):
    """The whole test index, built by ``Engine.create`` in the shared folder."""
    from lattiq.functions.scratch import Scratch
    from lattiq.plans.engine import Engine

    one = f.quantiles.first()  # one row
    return Engine(f"{Scratch(f.spark, 'index').root}/index", f.spark).create(f.tokens, centroids=f.centroids, buckets=(one.cutoffs, one.weights), nbits=NBITS)


def _found(f, engine):
    return engine.load().search_frame(f.queries.select("qid", "tok", "vec"), K, MAIN).select("qid", "rank", "pid", *r6("score"))


@query(f"with {_search(MAIN)} select qid, rank, pid, round(score, 6) as score from res")
def engine_search(f):
    return _found(f, _engine(f))


@query(ORACLE["search_tombstones"])
def engine_tombstones(f):
    engine = _engine(f)
    gone = f.tokens.select("pid").distinct().where("pid % 7 = 0")
    return _found(f, engine.delete([r.pid for r in gone.collect()], compact_threshold=None))


@query(f"with {_ASG} select cid, pid, count(*) as n from asg where pid % 7 <> 0 group by cid, pid")
def engine_compacted(f):
    """Postings after a deletion and compaction, under the numbers of the codebook before it."""
    engine = _engine(f)
    used = build.prune_empty(f.centroids, f.assigned.where("pid % 7 <> 0"))
    engine.delete([r.pid for r in f.tokens.select("pid").distinct().where("pid % 7 = 0").collect()], compact_threshold=None).compact()
    kept = engine.load()._open()["postings"]
    return kept.withColumnRenamed("cid", "new_cid").join(F.broadcast(used), "new_cid").groupBy("cid", "pid").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"with {_ASG}, n as (select max(pid) + 1 as w from asg) select cid, pid, count(*) as n from asg where pid not in (4, 9) group by cid, pid "
    "union all select t.cid, s.pid, count(*) from (values (4), (9)) s(pid) join asg t on t.pid = s.pid + 1 group by t.cid, s.pid "
    "union all select cid, pid + w, count(*) from asg, n group by cid, pid + w"
)
def engine_changed(f):
    """Postings after all documents were added once more under new ids and two were replaced by their successors."""
    engine = _engine(f)
    engine.add(f.tokens.select("pid", "pos", "vec"), min_outliers=1 << 60)
    after = f.tokens.where("pid in (5, 10)").selectExpr("if(pid = 5, 0L, 1L) as pid", "pos", "vec")
    engine.update([4, 9], after)
    return engine.load()._open()["postings"].groupBy("cid", "pid").agg(F.count(F.lit(1)).alias("n"))


# evaluation

_QREL = "qrel as (select q.qid, t.pid, 1 as rel from q join tok t on t.label = q.label where q.tok = 0 and t.pos = 0)"
_RUN = f"{_search(MAIN)}, {_QREL}, rr as (select res.qid, res.rank, res.pid, coalesce(qrel.rel, 0) as rel from res left join qrel on qrel.qid = res.qid and qrel.pid = res.pid where res.qid in (select qid from qrel)), nr as (select qid, count(*) as n from qrel group by qid)"


@query(
    f"with {_RUN}, idl as (select qid, sum(case when i <= 10 then 1 / log2(i + 1) else 0 end) as ideal from (select qid, row_number() over (partition by qid order by pid) as i from qrel) group by qid), "
    "got as (select qid, sum(case when rank <= 10 then rel / log2(rank + 1) else 0 end) as g from rr group by qid) select idl.qid, round(coalesce(g, 0) / ideal, 6) as value from idl left join got on got.qid = idl.qid"
)
def eval_ndcg10(f):
    return evaluate.ndcg(f.run(), f.qrels, 10).select("qid", *r6("value"))


@query(f"with {_RUN}, got as (select qid, sum(rel) as g from rr group by qid) select nr.qid, round(coalesce(g, 0) / n, 6) as value from nr left join got on got.qid = nr.qid")
def eval_recall10(f):
    return evaluate.recall(f.run(), f.qrels, 10).select("qid", *r6("value"))


@query(
    f"with {_RUN}, h as (select qid, rank, row_number() over (partition by qid order by rank) as nth from rr where rel > 0), got as (select qid, sum(nth / rank) as g from h group by qid) "
    "select nr.qid, round(coalesce(g, 0) / n, 6) as value from nr left join got on got.qid = nr.qid"
)
def eval_map(f):
    return evaluate.average_precision(f.run(), f.qrels).select("qid", *r6("value"))


@query(f"with {_RUN}, got as (select qid, sum(rel) filter (rank <= 3) as g from rr group by qid) select nr.qid, cast(coalesce(g, 0) as double) as value from nr left join got on got.qid = nr.qid")
def eval_hits3(f):
    return evaluate.hits(f.run(), f.qrels, 3)


@query("select doc_id as qid, text, min(doc_id) over (partition by text) as first_qid from documents where text is not null")
def dedup_queries(f):
    docs = f.table("documents")
    return evaluate.first_occurrence(docs.where("text is not null").selectExpr("doc_id as qid", "text"))


@query(f"with {_search(MAIN)} select qid, pid as doc_id, round(score, 6) as score from res where pid <> qid")
def self_match_removed(f):
    return evaluate.without_self(f.run()).select("qid", "doc_id", *r6("score"))


@query("select round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(avg(value), 6) as mean, round(min(value), 6) as min, round(max(value), 6) as max from events")
def latency_percentiles(f):
    events = f.table("events")
    return evaluate.latency(events.selectExpr("value as seconds")).select(*r6("p50", "p95", "p99", "mean", "min", "max"))


# metadata filters: one condition in the public dialect, run through the rewriter and as it is in DuckDB

_STORE = """md as (select doc_id as _passage_id, lang, n_chars, path, {'lang': lang, 'source': source} as author, string_split(path, '/') as tags,
  [n_chars::double, length(text)::double, null] as scores from documents)"""


def _store(f):
    return f.table("documents").selectExpr(
        "doc_id as _passage_id", "lang", "n_chars", "path", "struct(lang, source) as author", "split(path, '/') as tags",
        "array(cast(n_chars as double), cast(length(text) as double), cast(null as double)) as scores",
    )


def _filter(name: str, condition: str, parameters: list | None = None, oracle: str | None = None):
    bound = oracle or condition
    for p in parameters or []:
        bound = bound.replace("?", repr(p), 1)
    QUERIES[name] = lambda spark, d: predicates.matching(_store(Fixture(spark, d)), condition, parameters).select("_passage_id")
    ORACLE[name] = f"with {_STORE} select _passage_id from md where {bound}"


_filter("filter_eq_range", "lang = ? AND n_chars >= ?", ["python", 500])
_filter("filter_struct", "author.source = 'git_mirror' AND author['lang'] IS NOT NULL")
_filter("filter_struct_extract", "struct_extract(author, 'source') IN ('code_dump', 'vendor_scan')")
_filter("filter_list_contains", "list_contains(tags, ?)", ["src"])
_filter("filter_list_len", "len(tags) > 2 AND len(lang) < 5")
_filter("filter_has_any", "list_has_any(tags, ['docs', 'notes'])")
_filter("filter_has_all", "list_has_all(tags, ['src'])")
_filter("filter_lambda", "len(list_filter(scores, x -> x > 2000)) > 0", oracle="len(list_filter(scores, lambda x: x > 2000)) > 0")
_filter("filter_lambda_new", "len(list_filter(scores, lambda x: x > 900)) = 2")
_filter("filter_transform", "list_sum(list_transform(scores, x -> x * 2)) > 4000", oracle="list_sum(list_transform(scores, lambda x: x * 2)) > 4000")
_filter("filter_list_sum", "list_aggregate(scores, 'sum') > 5000")
_filter("filter_list_stats", "list_aggregate(scores, 'max') > 3000 OR list_aggregate(scores, 'avg') < 400 OR list_aggregate(scores, 'count') < 2")
_filter("filter_index", "tags[1] = 'src' OR tags[-1] = 'README.md'")
_filter("filter_slice", "len(tags[2:3]) = 2")
_filter("filter_null", "lang IS NULL OR n_chars IS NULL")
_filter("filter_distinct_from", "lang IS DISTINCT FROM 'python' AND NOT (n_chars > 1000)")
_filter("filter_string", "lang ILIKE 'java%' AND n_chars // 100 % 2 = 0")
_filter("filter_cast", "n_chars::VARCHAR LIKE '1%' AND lang || '!' <> 'c!'")
_filter("filter_regexp", "regexp_matches(path, '[0-9]+[.]py$')")
_filter("filter_between", "n_chars BETWEEN 100 AND 900 AND lang NOT IN ('c', 'rust')")


@query("select event_id from events where props ->> 'k' = '69' or (props ->> 'k')::int > 95")
def filter_json(f):
    return predicates.matching(f.table("events"), "props ->> 'k' = '69' or (props ->> 'k')::int > 95").select("event_id")


@query("select doc_id::varchar as doc_id, lang, word from (select doc_id, lang from documents union all by name select lang, word from common_words)")
def schema_evolution(f):
    return f.table("documents").select("doc_id", "lang").unionByName(f.table("common_words").select("lang", "word"), allowMissingColumns=True).withColumn("doc_id", F.col("doc_id").cast("string"))

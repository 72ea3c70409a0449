"""Driver queries of the readers: the documents corpus is written in a format and read back, and facts of what was read are held against the SQL of the corpus."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import Corpus, delete, ruled, stored, value
from .functions.text import numbered, numbered_with_sums
from .session import Session
from .sources import conllu, cwb_binary, jsonl, ptb, vrt
from .sources.tables import ANNOTATION, corpus_of, lines_of, scratch, spaced

_read: dict[tuple, Corpus] = {}

#: Sentences that a file has at least, of those that are written here.
PART = 1000


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with tokens, in their order, in partitions that follow each other: doc_id, lang, lines, and first_line, the number of sentences before.

    Texts shuffle once. Where the partitions are cut and how many sentences come before each is found beforehand, of numbers alone.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("lang", F.lit("_")).alias("lang"), "text")
    bare = F.replace(spaced(F.col("text")), F.lit(" "), F.lit(""))
    lines = docs.select("doc_id", F.size(F.array_remove(F.split(bare, "\n"), "")).cast("long").alias("n_lines")).filter("doc_id IS NOT NULL AND n_lines > 0")
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    counts = numbered_with_sums(lines, ["doc_id"], "rid", lambda df: df, {"n_lines": "first_line"}, path)
    total = counts.agg(F.coalesce(F.sum("n_lines"), F.lit(0))).first()[0]
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART))
    cuts = counts.groupBy(F.expr(f"first_line div {total // parts + 1}")).agg(F.min(F.struct("doc_id", "first_line")).alias("cut"))
    cuts = sorted((r["cut"]["doc_id"], r["cut"]["first_line"]) for r in cuts.collect()) or [(0, 0)]  # a row a partition
    delete(spark, path)
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    part = F.greatest(F.size(F.filter(longs([d for d, _ in cuts]), lambda d: d <= F.col("doc_id"))) - 1, F.lit(0))
    return docs.filter("doc_id IS NOT NULL").withColumn("part", part).repartitionById(len(cuts), "part").sortWithinPartitions("doc_id").withColumns({"before": F.element_at(longs([n for _, n in cuts]), F.col("part") + 1), "lines": lines_of(F.col("text"))}).drop("text", "part")


def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotated tokens of the documents, in order, with place and length of their sentence, its number (sent_id) and second form, and whether they begin or end a text."""
    sents = ordered(spark, sf_dir).select("doc_id", "lang", "before", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("k", "words"))
    # sentences of a partition are numbered as they come
    sents = sents.withColumn("sent_id", F.col("before") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    tokens = sents.select("doc_id", "lang", "sent_id", "k", "n_lines", F.size("words").alias("sent_len"), F.try_element_at("words", F.lit(2)).alias("second"), F.posexplode("words").alias("at", "form"))
    tokens = tokens.withColumns({"sent_at": F.col("at") + 1, "pos": F.col("at").cast("long"), "opens": F.expr("k = 0 AND at = 0"), "closes": F.expr("k = n_lines - 1 AND at = sent_len - 1")})
    return ruled(tokens, ANNOTATION)


def written(tokens: DataFrame, line: Column, text: tuple[Column | None, Column | None], sentence: tuple[Column | None, Column | None]) -> str:
    """A text file for each partition, in order; readers number files by path. `line` of each token, and what comes before and after of each text and sentence.

    Compressed, as a line repeats much of the one before.
    """
    path = f"{scratch(tokens.sparkSession)}/{uuid.uuid4().hex}"
    parts = [("opens", text[0]), ("sent_at = 1", sentence[0]), ("true", line), ("sent_at = sent_len", sentence[1]), ("closes", text[1])]
    value = F.concat_ws("\n", *[F.when(F.expr(condition), c) for condition, c in parts if c is not None])
    tokens.select(value.alias("value")).write.option("compression", "gzip").text(path)
    return path


def once(kind: str, build: Callable[[SparkSession, str], Corpus]) -> Callable[[SparkSession, str], Corpus]:
    def run(spark: SparkSession, sf_dir: str) -> Corpus:
        key = (spark.sparkContext.applicationId, sf_dir, kind)
        if key not in _read:
            _read[key] = build(spark, sf_dir)
        return _read[key]

    return run


# ------------------------------------------------------------------ formats
def _conllu_files(spark: SparkSession, sf_dir: str) -> str:
    number = F.col("sent_at").cast("string")
    line = F.concat_ws("\t", number, "form", "lemma", "upos", F.lit("_"), "feats", F.expr("string(sent_at div 2)"), "deprel", F.lit("_"), F.concat(F.lit("Gloss="), F.col("upos"), F.lit("|Other=1")))
    empty = F.when(F.expr("sent_at = 1"), F.lit("1.1\tx\tx\tX\t_\t_\t_\t_\t_\t_"))
    both = F.when(F.expr("sent_len > 1"), F.concat(F.lit("1-2\t"), "form", "second", F.lit("\t_\t_\t_\t_\t_\t_\t_\t_")))
    begin = F.concat_ws("\n", F.concat(F.lit("# sent_id = s"), F.col("sent_id").cast("string")), both)
    text = F.concat(F.lit("# newregion text\n# text_id = "), F.col("doc_id").cast("string"), F.lit("\n# text_lang = "), F.col("lang"))
    return written(token_lines(spark, sf_dir), F.concat_ws("\n", line, empty), (text, None), (begin, F.lit("")))


def _xml(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _vrt_files(spark: SparkSession, sf_dir: str) -> str:
    text = F.concat(F.lit('<!-- #vrt positional-attributes: word lemma pos -->\n<text id="'), F.col("doc_id").cast("string"), F.lit('" lang="'), _xml(F.col("lang")), F.lit('">'))
    sentence = F.concat(F.lit('<s id="s'), F.col("sent_id").cast("string"), F.lit('">'))
    return written(token_lines(spark, sf_dir), F.concat_ws("\t", _xml(F.col("form")), _xml(F.col("lemma")), "upos"), (text, F.lit("</text>")), (sentence, F.lit("</s>\n<pause/>")))


def _events(version: int) -> Callable[[SparkSession, str], str]:
    kind = "type" if version == 2 else "event"

    def event(name: str, *cols: Column) -> Column:
        return F.to_json(F.struct(F.lit(name).alias(kind), *cols))

    def run(spark: SparkSession, sf_dir: str) -> str:
        names = F.array(*map(F.lit, ("form", "lemma", "upos", "tags"))).alias("positional")
        head = event("header", F.lit(version).alias("version"), names, F.array(F.lit("tags")).alias("multivalue"), F.lit("s").alias("default_within"))
        attrs = F.struct(F.col("doc_id").cast("string").alias("id"), "lang").alias("attrs")
        opened, closed = event("region_start", F.lit("text").alias("struct"), attrs), event("region_end", F.lit("text").alias("struct"))
        attrs = F.struct(F.concat(F.lit("s"), F.col("sent_id").cast("string")).alias("id")).alias("attrs")
        if version == 1:
            line = event("token", F.col("form"), F.col("lemma"), F.col("upos"), F.col("tags"), F.expr("nullif(sent_at div 2, 0)").alias("head"))
            end = event("sentence_end", attrs)
        else:
            line = event("token", F.array("form", "lemma", "upos", "tags").alias("v"), F.col("sent_at").cast("string").alias("tok_id"), F.expr("string(nullif(sent_at div 2, 0))").alias("head_tok_id"))
            end = event("region", F.lit("s").alias("struct"), F.lit(0).alias("start_pos"), F.lit(0).alias("end_pos"), attrs)
        return written(token_lines(spark, sf_dir), line, (F.concat_ws("\n", head, opened), closed), (None, end))

    return run


def _bracket_files(spark: SparkSession, sf_dir: str) -> str:
    """Each sentence: S over NP (its first two tokens) and the rest."""
    leaf = F.concat(F.lit("("), F.col("upos"), F.lit(" "), F.translate("form", "()", "[]"), F.lit(")"), F.when(F.expr("sent_at = least(2, sent_len)"), F.lit(")")).otherwise(""))
    return written(token_lines(spark, sf_dir), leaf, (None, None), (F.lit("( (S (NP-SBJ"), F.lit("(NP (-NONE- *T*))) )")))


def _binary_files(spark: SparkSession, sf_dir: str) -> str:
    """word.corpus, word.lexicon and s.avx; the format has one file for each, so each is written by one task, batch by batch."""
    c, path = corpus_of(spark, sf_dir), f"{scratch(spark)}/{uuid.uuid4().hex}"
    words = numbered(c.tokens.select("lemma").distinct(), ["lemma"], "id", f"{path}-words")
    ints = lambda b: np.column_stack([x.to_numpy() for x in b.columns]).astype("<i4").tobytes()

    def put(rows: DataFrame, order: str, cols: list[str], name: str, encode: Callable[[pa.RecordBatch], bytes]) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            where, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
            where.create_dir(root, recursive=True)
            with where.open_output_stream(f"{root}/{name}") as out:
                for batch in batches:
                    out.write(encode(batch))
            yield pa.RecordBatch.from_pydict({"done": pa.array([True])})

        rows.repartition(1).sortWithinPartitions(order).select(*cols).mapInArrow(run, "done boolean").collect()

    put(c.tokens.select("pos", "lemma").join(words, "lemma"), "pos", ["id"], "word.corpus", ints)
    put(words, "id", ["lemma"], "word.lexicon", lambda b: b"".join(x.encode() + b"\0" for x in b.column(0).to_pylist()))
    put(c.structs["s"], "start", ["start", "end"], "s.avx", ints)
    return path


read_binary = once("binary", lambda spark, d: cwb_binary.read(spark, _binary_files(spark, d), ["word"], ["s"]))
read_conllu = once("conllu", lambda spark, d: conllu.read(spark, _conllu_files(spark, d), pattern="*.txt.gz"))
read_split = once("conllu-split", lambda spark, d: conllu.read(spark, _conllu_files(spark, d), split_feats=True, pattern="*.txt.gz"))
read_vrt = once("vrt", lambda spark, d: vrt.read(spark, _vrt_files(spark, d), pattern="*.txt.gz"))
read_v1 = once("jsonl-1", lambda spark, d: jsonl.read(spark, _events(1)(spark, d), pattern="*.txt.gz"))
read_v2 = once("jsonl-2", lambda spark, d: jsonl.read(spark, _events(2)(spark, d), pattern="*.txt.gz"))
read_brackets = once("brackets", lambda spark, d: ptb.read(spark, _bracket_files(spark, d), pattern="*.txt.gz"))


# -------------------------------------------------------------------- facts
def profile(read: Callable[[SparkSession, str], Corpus], tree: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    """Per text: its tokens, sentences, sums over positions, heads and depths, characters of forms and lemmas."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = read(spark, sf_dir)
        text = c.structs["text"].select(F.col("idx").alias("r_text"), "id", "lang")
        more = [F.coalesce(F.sum("head_pos"), F.lit(0)).alias("heads"), F.sum("depth").alias("depths"), F.sum("n_children").alias("children")] if tree else []
        # a row a text, so that no token meets its text in a join
        per = c.tokens.groupBy("r_text").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("sent_id").alias("sents"), F.sum("pos").alias("places"), F.sum(F.char_length("form")).alias("form_chars"), F.sum(F.char_length("lemma")).alias("lemma_chars"), *more)
        return per.join(text, "r_text").drop("r_text")

    return run


PROFILE = "SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(lang, '_') AS lang, CAST(count(*) AS BIGINT) AS tokens, count(DISTINCT sent_id) AS sents, CAST(sum(pos) AS BIGINT) AS places, CAST(sum(length(form)) AS BIGINT) AS form_chars, CAST(sum(length(lemma)) AS BIGINT) AS lemma_chars{more} FROM t JOIN d USING (doc_id) GROUP BY 1, 2"
TREE = ", CAST(coalesce(sum(head_pos), 0) AS BIGINT) AS heads, CAST(sum(length(ltrim(bin(i), '0')) - 1) AS BIGINT) AS depths, CAST(sum(CASE WHEN i > 1 THEN 1 ELSE 0 END) AS BIGINT) AS children"


def asked(read: Callable[[SparkSession, str], Corpus], program: str, names: dict[str, str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Session(read(spark, sf_dir))
        s.settings["group_limit"] = 0
        df = s.run(program)
        return df.select(*[(F.round(F.col(f"`{f.name}`"), 6) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`")).alias((names or {}).get(f.name, f.name)) for f in df.schema.fields])

    return run


def regions(read: Callable[[SparkSession, str], Corpus], struct: str, *attrs: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: read(spark, sf_dir).structs[struct].select("start", "end", *[value(stored(a)).alias(a) for a in attrs])


def share(by: str, name: str, where: str = "true") -> str:
    return f"SELECT {by} AS {name}, CAST(count(*) AS BIGINT) AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM t WHERE {where} GROUP BY 1"


def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of tokens and two-part groups of another file, laid over the corpus and asked for together with its own attributes."""
    base = corpus_of(spark, sf_dir)
    every = base.structs["s"].select("start", "end")
    region = F.to_json(F.struct(F.lit("region").alias("type"), F.lit("blk").alias("struct"), F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.struct((F.col("end") - F.col("start") + 1).cast("string").alias("len")).alias("attrs")))
    head = spark.range(1).select(F.to_json(F.struct(F.lit("header").alias("type"), F.lit(2).alias("version"), F.lit(base.meta.size).alias("token_count"))).alias("value"))
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    # a line a region, so that no task holds more than a line
    head.union(every.select(region.alias("value"))).write.option("compression", "gzip").text(path)
    layer = jsonl.read_overlay(spark, path, base.meta.size, pattern="*.txt.gz")
    s = Session(base.overlay("x", layer))
    return s.run('[upos="ADJ" & overlay-x-blk_len="7"]; size')


def _check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the consistency check counts in the corpus, and in one that lacks every thousandth token and has a span beyond the end."""
    c = corpus_of(spark, sf_dir)
    broken = Corpus(c.tokens.filter("pos % 1000 <> 500"), c.structs | {"s": c.structs["s"].withColumn("end", F.when(F.col("idx") == 0, c.meta.size + 5).otherwise(F.col("end")))}, c.meta, c.groups)
    rows = [(name, rule, int(n)) for name, x in (("sound", c), ("broken", broken)) for rule, n in x.check().items()]
    return spark.createDataFrame(rows, "corpus string, rule string, n long")


def queries_with_sql(sql: Callable[..., str]) -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """Name to query and SQL; `sql` puts the corpus before a SELECT."""
    both = "sents.start, sents.start + 1 AS \"end\", a.form || b.form AS form FROM sents JOIN t a ON a.pos = sents.start JOIN t b ON b.pos = sents.start + 1 WHERE n > 1"
    missing = "SELECT CAST(count(*) AS BIGINT) FROM t WHERE pos % 1000 = 500"
    return {
        "read_conllu": (profile(read_conllu), sql(PROFILE.format(more=TREE))),
        "read_conllu_comments": (regions(read_conllu, "s", "sent_id"), sql("SELECT start, start + n - 1 AS \"end\", 's' || sent_id AS sent_id FROM sents")),
        "read_conllu_contractions": (regions(read_conllu, "contr", "form"), sql(f"SELECT {both}")),
        "read_conllu_misc": (asked(read_conllu, "[]; count by Gloss"), sql(share("upos", '"Gloss"'))),
        "read_conllu_feats": (asked(read_split, '[feats/Init="t"]; count by feats/Len', {"feats/Len": "len"}), sql(share("CAST(length(lemma) AS VARCHAR)", "len", "left(lemma, 1) = 't'"))),
        "read_vrt": (profile(read_vrt, tree=False), sql(PROFILE.format(more=""))),
        "read_vrt_regions": (regions(read_vrt, "pause"), sql("SELECT start + n AS start, start + n - 1 AS \"end\" FROM sents")),
        "read_jsonl_v1": (profile(read_v1), sql(PROFILE.format(more=TREE))),
        "read_jsonl_v2": (profile(read_v2), sql(PROFILE.format(more=TREE))),
        "read_jsonl_sets": (asked(read_v2, '[tags="even"] [tags="tee"]; size'), sql("SELECT CAST(count(*) AS BIGINT) AS size FROM t a JOIN t b ON b.pos = a.pos + 1 AND b.sent_id = a.sent_id WHERE list_contains(a.tags, 'even') AND list_contains(b.tags, 'tee')")),
        "read_overlay": (_overlay, sql("SELECT CAST(count(*) AS BIGINT) AS size FROM t WHERE upos = 'ADJ' AND sent_n = 7")),
        "read_brackets": (asked(read_brackets, 'n:<node type="NP">; count by n.func', {"n.func": "func"}), sql("SELECT 'SBJ' AS func, CAST(count(*) AS BIGINT) AS count, 100.0::DOUBLE AS pct FROM sents")),
        "read_bracket_nodes": (regions(read_brackets, "node", "type"), sql("SELECT start, start + n - 1 AS \"end\", 'S' AS type FROM sents UNION ALL SELECT start, start + least(n, 2) - 1, 'NP' FROM sents")),
        "read_binary": (asked(read_binary, "[] within s; count by form"), sql(share("lemma", "form"))),
        "read_binary_regions": (regions(read_binary, "s"), sql("SELECT start, start + n - 1 AS \"end\" FROM sents")),
        "consistency": (_check, sql(f"SELECT 'sound' AS corpus, unnest(['size', 'positions', 'heads', 'spans']) AS rule, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'broken', 'size', ({missing}) UNION ALL SELECT 'broken', 'positions', ({missing}) UNION ALL SELECT 'broken', 'heads', (SELECT CAST(count(*) AS BIGINT) FROM t WHERE head_pos % 1000 = 500 AND pos % 1000 <> 500) UNION ALL SELECT 'broken', 'spans', CAST(1 AS BIGINT)")),
    }

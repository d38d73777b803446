"""Domain views over the supplied test tables.

Only integer and string formulas, so that any SQL engine gives the same values.
FIXTURES.md states every formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from correctionlab.functions import fixed_values as V
from correctionlab.functions.expressions import era_column
from correctionlab.operators.patterns import as_patterns, correction_patterns, update_knowledge_base
from correctionlab.operators.rules import promote_rules
from correctionlab.schemas import RULES

EARLIER = "1996-01-01 00:00:00"
AS_OF = "2024-06-01 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread narrow rows evenly before each of them is turned into something much bigger."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, key)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def diffs(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """Flagged differences made of line items; `line` may be a stream of them."""
    line = table(spark, sf_dir, "lineitem") if line is None else line
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = line.join(part, line.l_partkey == part.p_partkey)
    types = F.array(*[F.lit(t) for t in V.DIFFERENCE_TYPES])
    brand = F.expr("cast(replace(p_brand, 'Brand#', '') as int)")
    t = F.expr("cast((l_linenumber + l_suppkey) % 9 as int)")
    helpers = joined.select(
        "*",
        brand.alias("b"),
        t.alias("t"),
        ((F.lit(7) * brand + F.lit(3) * t) % 11).alias("th"),
        F.expr("(5 * l_orderkey + 3 * l_partkey + l_suppkey) % 11").alias("u"),
    )
    decision = (
        F.when(F.expr("l_orderkey % 5 = 0"), None)
        .when(F.expr("u <= th"), "accept")
        .when(F.expr("(u - th) % 2 = 1"), "reject")
        .otherwise("edit")
    )
    edit_value = F.expr(
        "case l_partkey % 3 when 0 then '<rest/>' when 1 then 'add forte here' else '' end"
    )
    snippet = F.expr("concat(l_orderkey, '_', l_linenumber)")
    return helpers.select(
        F.expr(
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
            " cast(round(100 * l_extendedprice) as bigint))"
        ).alias("id"),
        F.col("l_orderkey").cast("string").alias("score_id"),
        F.col("l_linenumber").alias("measure_number"),
        F.when(F.col("b") == 25, "unknown").otherwise(F.col("p_brand")).alias("instrument"),
        F.element_at(types, F.col("t") + 1).alias("difference_type"),
        F.concat(F.lit("flag "), "l_returnflag", "l_linestatus").alias("description"),
        F.when(F.expr("l_partkey % 4 = 0"), "")
        .otherwise(F.concat(F.lit("snippets/"), snippet, F.lit(".png")))
        .alias("pdf_snippet_path"),
        F.concat(F.lit("xml/"), snippet, F.lit(".xml")).alias("musicxml_snippet_path"),
        (F.expr("cast(l_partkey % 101 as double)") / 100).alias("omr_confidence"),
        (F.expr("cast((7 * l_orderkey + 13 * l_linenumber) % 101 as double)") / 100)
        .alias("vision_confidence"),
        decision.alias("human_decision"),
        F.when(decision == "edit", edit_value).alias("human_edit_value"),
        F.when(decision.isNotNull(), F.col("l_shipdate")).alias("human_reviewed_at"),
        F.expr("l_orderkey % 5 = 0 and l_suppkey % 3 = 0").alias("auto_accepted"),
        F.lit(None).cast("string").alias("auto_accept_rule_id"),
        F.col("l_shipdate").alias("created_at"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    composers = F.expr(
        "case o_orderkey % 6 when 0 then 'Johann Sebastian Bach'"
        " when 1 then 'Wolfgang Amadeus Mozart' when 2 then 'Frederic Chopin'"
        " when 3 then 'Jacques Offenbach' when 4 then 'Unknown Person'"
        " else 'Clara Schumann' end"
    )
    base = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        composers.alias("composer"),
        F.expr(
            "case when o_orderkey % 3 = 0 then null else cast(1600 + o_orderkey % 400 as int) end"
        ).alias("year"),
        F.expr(
            "case o_orderstatus when 'F' then 'complete' when 'O' then 'review'"
            " else 'processing' end"
        ).alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )
    return base.withColumn("era", era_column(F.col("composer"), F.col("year")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
        .select("o_orderkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
        .select(
            F.col("o_orderkey").cast("string").alias("score_id"),
            F.col("k").alias("part_seq"),
            F.expr("concat('P', k + 1)").alias("part_id"),
            F.expr("concat('Brand#', 1 + (3 * o_orderkey + 5 * k) % 25)").alias("part_name"),
            F.col("k").alias("body_seq"),
        )
    )


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measure 7 is missing on purpose: edits on it have no target."""
    return (
        parts(spark, sf_dir)
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n"))
        .select(
            "score_id", "part_id", "part_seq", "part_name", "body_seq",
            (F.col("n") - 1).alias("measure_seq"),
            F.col("n").cast("string").alias("measure_number"),
            F.expr("concat('<measure number=\"', n, '\"><note/></measure>')").alias("xml"),
        )
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score document per order, made of the same parts and measures; one in five timewise,
    one in seven namespaced, one in eleven cut off in the middle. They are dealt by their score before the texts are made,
    so a join by score needs no shuffle of texts."""
    whole = F.concat(
        F.lit("<?xml version='1.0' encoding='utf-8'?>\n<"),
        F.expr(_ROOT),
        F.expr("case when o_orderkey % 7 = 0 then ' xmlns=\"http://example.org/music\"' else '' end"),
        F.lit(' version="4.0">'),
        F.expr(_HEAD),
        F.when(F.expr("o_orderkey % 5 = 0"), F.lit(_TIMEWISE)).otherwise(F.lit(_PARTWISE)),
        F.lit("</"), F.expr(_ROOT), F.lit(">"),
    )
    keys = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("score_id"), "o_orderkey", "o_custkey", "o_orderstatus")
    return spread(keys, "score_id").withColumn("whole", whole).select("score_id", F.expr(_CUT).alias("xml"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files (path, content): plain, in two-byte characters with a byte order mark, or in an archive."""
    def pack(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as archive:
                    archive.writestr("score.xml", content)
                yield pa.RecordBatch.from_pydict({"path": [path], "content": pa.array([held.getvalue()], pa.binary())})

    texts = documents(spark, sf_dir).withColumn("kind", F.col("score_id").cast("long") % 3)
    plain = texts.where("kind < 2").select(
        F.concat(F.lit("scores/"), "score_id", F.lit(".xml")).alias("path"),
        F.when(F.col("kind") == 0, F.encode("xml", "UTF-8")).otherwise(F.encode("xml", "UTF-16")).alias("content"))
    packed = texts.where("kind = 2").select(F.concat(F.lit("scores/"), "score_id", F.lit(".mxl")).alias("path"), F.encode("xml", "UTF-8").alias("content"))
    return plain.unionByName(packed.mapInArrow(pack, "path string, content binary"))


# the body of a document is the same in all of one layout, and its part list is written out part by part: functions over arrays are slow
def _listed(k: int) -> str:
    name = f"concat('Brand#', 1 + (3 * o_orderkey + 5 * {k}) % 25)"
    return (
        f"'<score-part id=\"P{k + 1}\"><part-name>', if(o_orderkey % 9 = 0, concat('<![CDATA[', {name}, ']]>'), {name}), '</part-name></score-part>',"
        f" if(o_orderkey % 6 = 0, '<part-group number=\"1\" type=\"{'stop' if k == 1 else 'start'}\"/>', '')"
    )


_HEAD = (
    "concat('<work><work-title> Order ', o_orderkey, ' </work-title>',"
    " case when o_orderkey % 2 = 0 then concat('<work-number>Op. ', o_custkey, '</work-number>')"
    " else '' end, '</work>',"
    " case when o_orderkey % 3 = 0 then '<movement-title>Allegro &amp; Coda</movement-title>' else '' end,"
    " '<identification><creator type=\"composer\">', o_orderstatus, '</creator>',"
    " case when o_orderkey % 4 = 0 then '<creator type=\"Arranger\">A</creator><creator"
    " type=\"arranger\">B</creator>' else '' end, '</identification>',"
    f" '<part-list>', {', '.join(_listed(k) for k in range(3))}, '</part-list>')"
)
_PARTWISE = "".join(
    f'<part id="P{k}">' + "".join(f'<measure number="{n}"><note/></measure>' for n in range(1, 7)) + "</part>" for k in range(1, 4))
_TIMEWISE = "".join(
    f'<measure number="{n}">' + "".join(f'<part id="P{k}"><note/></part>' for k in range(1, 4)) + "</measure>" for n in range(1, 7))
_ROOT = "case when o_orderkey % 5 = 0 then 'score-timewise' else 'score-partwise' end"
_CUT = (
    "substring(whole, 1, case when o_orderkey % 11 = 0 then length(whole) - 9 else length(whole) end)"
)


def decision_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Two events per score; each decides every diff of its score. Views are invalid decisions."""
    events = table(spark, sf_dir, "events") if events is None else events
    ev = events.select(
        F.expr("cast(event_id div 2 as string)").alias("score_id"),
        "event_id",
        "ts",
        F.expr(
            "case event_type when 'click' then 'accept' when 'purchase' then 'accept'"
            " when 'error' then 'reject' when 'signup' then 'edit' else event_type end"
        ).alias("decision"),
        F.expr(
            "case event_id % 3 when 0 then '<rest/>' when 1 then concat('k=',"
            " get_json_object(props, '$.k')) else '' end"
        ).alias("edit_value"),
        F.expr("case when event_id % 4 = 0 then 'bulk' else 'single' end").alias("kind"),
    )
    ids = diffs(spark, sf_dir).select(F.col("id").alias("diff_id"), "score_id")
    return ids.join(ev, "score_id").select(
        "diff_id", "score_id", "decision",
        F.expr("case when kind = 'single' then edit_value end").alias("edit_value"),
        "kind", "ts", "event_id",
    )


def bulk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines ask for accept, the others for reject; shipped ones ask twice, and the
    ones with quantity over 45 name the wrong score. Quantities below 4 ask for what bulk refuses."""
    line = table(spark, sf_dir, "lineitem")
    ids = F.expr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
        " cast(round(100 * l_extendedprice) as bigint))"
    )
    return line.where("l_returnflag <> 'N'").select(
        F.explode(F.expr("if(l_linestatus = 'F', array(0, 1), array(0))")).alias("repeat"),
        F.expr("cast(if(l_quantity > 45, l_orderkey + 1, l_orderkey) as string)").alias("score_id"),
        ids.alias("diff_id"),
        F.expr("case when l_quantity < 4 then 'edit' when l_returnflag = 'R' then 'accept' else 'reject' end").alias("decision"),
    ).drop("repeat")


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By event_id % 5: bare JSON, fenced JSON, JSON in prose, no difference, no JSON."""
    text = """
        case event_id % 5
          when 0 then concat('{"has_difference": true, "difference_type": "', event_type,
               '", "description": "k=', k, '", "confidence": 0.', lpad(event_id % 100, 2, '0'),
               ', "is_omr_error": true}')
          when 1 then concat('```json\\n{"has_difference": true, "difference_type": "', event_type,
               '", "description": "line one\\\\nline two"}\\n```')
          when 2 then concat('I can see a change. {"has_difference": 1, "description": "', event_type,
               '", "confidence": "0.75"} End of answer.')
          when 3 then concat('{"has_difference": false, "description": "', event_type, '"}')
          else concat('No structured answer for ', event_type)
        end
    """
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", F.get_json_object("props", "$.k"))
        .select(
            F.col("event_id").cast("string").alias("score_id"),
            F.expr("cast(1 + event_id % 4 as int)").alias("page_no"),
            F.expr("if(event_id % 2 = 0, 'unknown', 'Brand#3')").alias("instrument"),
            F.expr(text).alias("response_text"),
        )
    )


def recogniser_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = """
        case event_id % 3
          when 0 then concat('INFO start\\nGRADE: ', event_id % 130 div 100, '.',
               lpad(event_id % 130 % 100, 2, '0'), ' of book\\nrecognition: 10%')
          when 1 then concat('INFO start\\nRecognition  ', event_id % 120, '% done')
          else concat('INFO ', event_type)
        end
    """
    logs = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("score_id"), F.expr(log).alias("log_text"),
        F.col("ts").alias("logged_at"), (F.col("event_id") % 7 == 0).alias("again"),
    )
    # a second run, a day later, of each seventh score
    more = logs.where("again").select(
        "score_id", F.lit("INFO again\ngrade: 0.25").alias("log_text"), (F.col("logged_at") + F.expr("interval 1 day")).alias("logged_at"))
    return logs.drop("again").unionByName(more)


def page_images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scanned pages and rendered pages of each score; the counts differ."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")

    def side(divisor: int, prefix: str, ext: str) -> DataFrame:
        n = F.expr(f"cast(1 + o_orderkey % {divisor} as int)")
        return orders.select("o_orderkey", F.explode(F.sequence(F.lit(1), n)).alias("page_no")).select(
            F.col("o_orderkey").cast("string").alias("score_id"),
            "page_no",
            F.concat(
                F.lit(f"{prefix}/"), F.col("o_orderkey").cast("string"), F.lit("_"),
                F.col("page_no").cast("string"), F.expr(ext),
            ).alias("path"),
        )

    return (
        side(4, "scan", "case page_no % 3 when 0 then '.JPG' when 1 then '.png' else '.tiff' end"),
        side(3, "render", "'.webp'"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.expr("concat('user', c_custkey, '@example.org')").alias("email"),
        F.lit("user").alias("role"),
    )


ADMIN_EMAILS = tuple(f"user{k}@example.org" for k in range(5))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.expr("concat('pay_', o_orderkey)").alias("id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderkey").cast("string").alias("score_id"),
        F.expr("concat('cs_', o_orderkey)").alias("session_id"),
        F.lit(None).cast("string").alias("payment_intent"),
        F.lit(V.PRICE_CENTS).alias("amount_cents"),
        F.lit(V.CURRENCY).alias("currency"),
        F.lit("pending").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"),
    )


def webhook_payloads(events: DataFrame) -> DataFrame:
    """Nested JSON bodies made of the event rows; every body arrives twice, a minute apart.
    Sign-ups lack the user; errors name a session nobody recorded."""
    body = """
        concat('{"type":"', case when event_type in ('purchase', 'signup', 'error')
                 then 'checkout.session.completed' else 'checkout.session.expired' end,
               '","data":{"object":{"id":"', if(event_type = 'error', 'cs_x', 'cs_'), event_id,
               '","payment_intent":"pi_', event_id, '","metadata":{',
               if(event_type = 'signup', '', concat('"user_id":"', user_id, '",')),
               '"score_id":"', event_id, '"}}}}')
    """
    return events.select(
        "event_id", "ts", "event_type", F.expr(body).alias("body"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt"),
    ).select(
        "event_id",
        (F.col("ts") + F.make_dt_interval(mins=F.col("attempt"))).alias("ts"),
        "attempt", "body",
    )


def payment_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webhook_payloads(table(spark, sf_dir, "events"))


def score_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants that exist already: finished orders, and purchases over 100."""
    from_orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderkey").cast("string").alias("score_id"),
        F.lit(V.VISION_FEATURE).alias("feature"),
        F.lit("payment").alias("access_type"),
        F.col("o_orderdate").alias("granted_at"),
    )
    from_events = table(spark, sf_dir, "events").where("event_type = 'purchase' and value > 100").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_id").cast("string").alias("score_id"),
        F.lit(V.VISION_FEATURE).alias("feature"),
        F.lit("payment").alias("access_type"),
        F.col("ts").alias("granted_at"),
    )
    return from_orders.unionByName(from_events)


def access_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_id").cast("string").alias("score_id"),
        F.lit(V.VISION_FEATURE).alias("feature"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), "ts")


def action_requests(events: DataFrame) -> DataFrame:
    """A few busy clients, each event a request for one action; `events` may be a stream."""
    actions = F.array(*[F.lit(a) for a in V.REQUEST_LIMITS])
    return events.select(
        (F.col("user_id") % 2).alias("client"), "ts", F.get(actions, (F.col("event_id") % 3).cast("int")).alias("action"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


WORK_COMPOSERS = ("Johann Sebastian Bach", "W. A. Mozart", "Clara Schumann", "Erik Satie", "Georg Philipp Telemann")


def work_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages below heads that tell a composer: in an infobox, in the heading, by categories, wrongly, or not at all.

    Nested tables, cells without an end tag, other rows before, and pages where several places name one.
    """
    names = F.array(*[F.lit(n) for n in WORK_COMPOSERS])
    name, other = (F.element_at(names, ((F.col("page_id") + k) % 5 + 1).cast("int")) for k in (0, 1))
    cell = F.concat(F.lit("<table class='box'><tr><th>Key<td>C minor</tr><tr><th scope='row'> COMPOSER </th><td><a href='/p'>"), name, F.lit("</a></td></tr></table>"))
    heading = F.concat(F.lit("<h1 id='top' class='firstHeading big'>Suite no. "), F.col("page_id").cast("string"), F.lit(" ("), other, F.lit(")</h1>"))
    generic = "<a href='/wiki/Category:Piano_works'>For piano</a><a href=\"/wiki/Category:Baroque\">Baroque style</a>"
    category = F.concat(F.lit(generic), F.lit("<a title='x' href='/wiki/Category:N'> "), name, F.lit(" </a>"))
    head = (
        F.when(F.expr("page_id % 7 = 0"), F.concat(heading, cell, category)).when(F.expr("page_id % 7 = 1"), F.concat(heading, category))
        .when(F.expr("page_id % 7 = 2"), category).when(F.expr("page_id % 7 = 3"), F.concat(F.lit("<table><tr><th>Composer</th><td> </td></tr></table>"), heading))
        .when(F.expr("page_id % 7 = 4"), F.lit(generic)).when(F.expr("page_id % 7 = 5"), F.concat(F.lit("<!-- "), cell, F.lit(" -->"), category))
        .otherwise(F.lit("<h1 class='firstHeading'>Suite (unfinished) in C</h1>"))
    )
    return pages(spark, sf_dir).select("page_id", "url", F.concat(head, "html").alias("html"))


def prompt_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt version for each part, with rates where it was used."""
    used = F.col("p_size") * 3 - 30
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("pv-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").cast("int").alias("version"), F.col("p_name").alias("prompt_text"),
        F.greatest(used, F.lit(0)).cast("bigint").alias("total_uses"), (F.col("p_partkey") % 3 != 0).alias("is_active"), F.lit(EARLIER).cast("timestamp_ntz").alias("created_at"),
        F.when(used > 0, (F.col("p_partkey") % 101) / F.lit(100.0)).alias("accept_rate"), F.when(used > 0, F.lit(1.0) - (F.col("p_partkey") % 101) / F.lit(100.0)).alias("reject_rate"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made of whole document texts: some with a magic prefix, some only with a suffix."""
    head = """
        case doc_id % 5 when 0 then '%PDF-1.7\n' when 1 then '<?XML version="1.0"?>\n'
          when 2 then '<!-- made -->\n<Score-Partwise>' else '' end
    """
    ext = """
        case doc_id % 7 when 0 then '.PDF' when 1 then '.xml' when 2 then '.musicxml'
          when 3 then '.mxl' when 4 then '.docx' when 5 then '.txt' else '' end
    """
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("uploads/"), F.col("doc_id").cast("string"), F.expr(ext)).alias("path"),
        F.concat(F.expr(head), F.col("text")).cast("binary").alias("content"),
    )


def engraving_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"""
        case doc_id % 4
          when 0 then concat('\\version "2.24.0"\n\n', text)
          when 1 then text
          when 2 then concat('\\version "2.24.0"\n\\header  { title = "x" }\n', text)
          else concat('% note\n\\version "2.22.1"  \n', text)
        end
    """
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(text).alias("content"))


def engraving_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    def unless_seventh(sql: str) -> Column:
        return F.expr(f"case when doc_id % 7 <> 0 then {sql} end")

    return table(spark, sf_dir, "documents").select(
        "doc_id",
        unless_seventh("concat('The \"Doc\" ', doc_id)").alias("title"),
        unless_seventh("case when doc_id % 2 = 0 then lang end").alias("subtitle"),
        unless_seventh("source").alias("composer"),
        unless_seventh("case when doc_id % 3 = 0 then concat('Op. ', n_chars) end").alias("opus"),
        unless_seventh("case when doc_id % 5 = 0 then upper(lang) end").alias("arranger"),
    )


# --- an earlier state of the learning loop -----------------------------------------


def earlier_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge base of the diffs before 1996 without clefs; beams belong to an era."""
    early = diffs(spark, sf_dir).where(
        (F.col("created_at") < F.lit(EARLIER).cast("timestamp_ntz")) & (F.col("difference_type") != "clef")
    )
    base = as_patterns(correction_patterns(early), F.lit(EARLIER).cast("timestamp_ntz"))
    return base.withColumn(
        "era", F.expr("case difference_type when 'beam' then 'romantic' when 'slur' then '' end")
    )


def current_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis of all diffs except notes, so that old note patterns are not mentioned."""
    return correction_patterns(diffs(spark, sf_dir).where("difference_type <> 'note'"))


def current_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return update_knowledge_base(
        earlier_patterns(spark, sf_dir), current_analysis(spark, sf_dir), as_of()
    )


def earlier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the earlier patterns. Rhythm rules want 500 confirmations; rules on dynamics hold
    for any instrument."""
    empty = spark.createDataFrame([], RULES).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    rules = promote_rules(earlier_patterns(spark, sf_dir), empty, F.lit(EARLIER).cast("timestamp_ntz"))
    return rules.withColumns({
        "min_confirmations": F.expr("if(difference_type = 'rhythm', 500L, 10L)"),
        "instrument": F.expr("if(difference_type = 'dynamic', null, instrument)"),
    })


def current_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promote_rules(current_patterns(spark, sf_dir), earlier_rules(spark, sf_dir), as_of())

"""Deterministic inputs derived from the driver's tables, by expressions that Spark and DuckDB both run.

chr(92) is a backslash, chr(10) a newline, chr(96) a back-tick: so spelt they mean the same in both dialects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One raw engine response per part; twelve kinds, one per branch of cleaning and gates.
OCR_RAW = """case p_partkey % 12
 when 0 then concat(concat(chr(96),chr(96),chr(96)),'latex',chr(10),chr(92),'[ x_',cast(p_size as varchar(10)),' ',chr(92),']',chr(10),concat(chr(96),chr(96),chr(96)))
 when 1 then concat('Here is the formula: $a − ',cast(p_size as varchar(10)),' < z$')
 when 2 then concat(chr(92),'( ',chr(92),'frac{a}{',cast(p_size as varchar(10)),'} ',chr(92),')')
 when 3 then concat('-x + ',cast(p_size as varchar(10)))
 when 4 then concat('αβ ≤ ',cast(p_size as varchar(10)),' ∈ S')
 when 5 then 'Sorry, I cannot determine this formula'
 when 6 then concat(chr(92),'frac{a}{',cast(p_size as varchar(10)))
 when 7 then concat('[a,',cast(p_size as varchar(10)),')')
 when 8 then ''
 when 9 then concat('Answer: y = ',cast(p_size as varchar(10)),chr(10),'some plain prose here')
 when 10 then concat('a',chr(92),chr(92),'[2pt] b_',cast(p_size as varchar(10)))
 else concat(chr(92),'(s',chr(92),')htarrow A^{}') end"""

#: Three formula images and one ordinary picture in a text's first 80 characters.
DOCS_MD_HEAD = """concat(substr(replace(text,chr(10),' '),1,40),' ![](media/image',cast(doc_id as varchar(20)),'.wmf) mid',chr(10),chr(10),'![alt](media',chr(92),'Eq',cast(doc_id as varchar(20)),'.EMF){width=1in}',chr(10),chr(10),'See ![fig](media/photo',cast(doc_id%7 as varchar(20)),'.png) and ![](<media/sp ace',cast(doc_id as varchar(20)),'.wmf>)',chr(10),substr(replace(text,chr(10),' '),41,40))"""
#: The same with the rest of the text after it, lines and all.
DOCS_MD = f"concat({DOCS_MD_HEAD},substr(text,81))"

#: Where the first line after a text's middle ends; the whole text where there is none.
CUT = "case when instr(substr(text,cast(floor(length(text)/2) as int)+1),chr(10))>0 then cast(floor(length(text)/2) as int)+instr(substr(text,cast(floor(length(text)/2) as int)+1),chr(10))-1 else length(text) end"
#: Markdown of the whole text, newlines kept: one formula image at the end of a line in its middle, the others after its end.
DOCS_WHOLE = f"""concat(substr(text,1,{CUT}),' ![](media/image',cast(doc_id as varchar(20)),'.wmf) mid',substr(text,{CUT}+1),chr(10),chr(10),'![alt](media',chr(92),'Eq',cast(doc_id as varchar(20)),'.EMF){{width=1in}}',chr(10),chr(10),'See ![fig](media/photo',cast(doc_id%7 as varchar(20)),'.png) and ![](<media/sp ace',cast(doc_id as varchar(20)),'.wmf>)',chr(10))"""

#: Whole texts with links whose brackets nest, escape each other, stay open or reach into the next link.
DOCS_NESTED = f"""concat(substr(text,1,{CUT}),' ![a',chr(92),']](media/eq (',cast(doc_id as varchar(20)),')/f(x).wmf) {{w={{1}}}} mid',substr(text,{CUT}+1),chr(10),'![b ![c](<a (',cast(doc_id as varchar(20)),'>c.emf>){{open',chr(10),'![d](e ![f',cast(doc_id as varchar(20)),') ](g)',chr(10))"""

#: TeX with fragments of four kinds per document, then its whole text with dollars escaped as TeX needs them; the
#: single-dollar pattern also matches inside the double dollars.
DOCS_TEX = """concat('Start ',chr(92),'[ a_',cast(doc_id as varchar(20)),' ',chr(92),'] then $$b+',cast(doc_id%5 as varchar(20)),'$$ and ',chr(92),'begin{align*}c=',cast(doc_id as varchar(20)),chr(92),'end{align*} or ',chr(92),'(d_1',chr(92),') end',chr(10),replace(text,'$',concat(chr(92),'$')))"""

#: Output of a command-line engine, and a TeX log, per part.
CLI_OUT = """case p_partkey % 5
 when 0 then concat('Loading model',chr(10),'50%|#####| 1/2',chr(10),'Predicted LaTeX: x^2 + y_',cast(p_size as varchar(10)),chr(10),'footer done')
 when 1 then concat('latex:',chr(10),concat(chr(96),chr(96),chr(96)),'tex',chr(10),chr(92),'frac{a}{',cast(p_size as varchar(10)),'}',chr(10),concat(chr(96),chr(96),chr(96)))
 when 2 then concat('elapsed 3 s',chr(10),'z = ',cast(p_size as varchar(10)),chr(10),'w = 1',chr(10),'saved to out')
 when 3 then 'nothing here'
 else '' end"""
TEX_LOG = """case p_partkey % 4
 when 0 then concat('This is TeX',chr(10),'! Missing $ inserted.',chr(10),'l.5 x',chr(10),'! Emergency stop.',chr(10))
 when 1 then concat('ok',chr(10),'  Undefined control sequence ',chr(92),'foo',cast(p_size as varchar(10)),'  ',chr(10),'end')
 when 2 then concat('plain output ',cast(p_size as varchar(10)))
 else '' end"""

#: Order of a formula's candidates; (l_orderkey, l_linenumber) is not unique, so every column takes part.
ORDER = "l_linenumber,l_partkey,l_suppkey,l_shipdate,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus"
CANDIDATES = f"""cast(row_number() over (partition by l_orderkey order by {ORDER}) as bigint) as idx, l_orderkey as formula_id,
 case l_returnflag when 'A' then 'pix2tex' when 'N' then 'texteller' else 'ollama_qwen' end as source, 'original' as variant,
 case when l_linenumber = 7 then '' else concat('x_{{',cast(l_partkey as varchar(20)),'}}') end as latex,
 case when l_linestatus='F' or l_linenumber%2=0 then 'valid' else 'invalid' end as validation_status,
 case when l_suppkey%11=0 then null else cast(100-5*cast(round(l_discount*100) as int) as double)/100 end as visual_score,
 case when l_quantity<3 then 'old' else 'now' end as latex_hash, case when l_tax<0.02 then null else 'preview' end as preview_png"""
#: Formulas with the selection of an earlier run: some manual, some without LaTeX.
FORMULAS = """o_orderkey as formula_id, o_custkey as doc_id,
 case when o_orderpriority='1-URGENT' then '' else concat('s_{',cast(o_orderkey as varchar(20)),'}') end as selected_latex,
 case when o_orderstatus='P' then 'manual' else 'pix2tex' end as selected_source,
 case when o_orderstatus='P' then 'manual:manual:1' else 'pix2tex:original:1' end as selected_candidate_key,
 case o_orderstatus when 'F' then 'valid' when 'O' then 'invalid' else 'pending' end as validation_status"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str, *expressions: str) -> DataFrame:
    """A projection of a table; expressions may hold several columns each, as in the SQL above."""
    view = f"mathlake_{name}"
    table(spark, sf_dir, name).createOrReplaceTempView(view)
    return spark.sql(f"select {', '.join(expressions)} from {view}")


def grey(c: str) -> Column:
    """Vectors of single precision as grey values, in single precision as in the SQL: Spark takes whole numbers beside it for doubles."""
    one = lambda n: F.lit(n).cast("float")
    return F.transform(c, lambda x: F.floor((x + one(1)) * one(127)).cast("int"))


def ocr_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "part", "p_partkey as cand_id", "p_size", f"{OCR_RAW} as raw")


def docs_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "documents", "doc_id", f"{DOCS_MD} as markdown")


def docs_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "documents", "doc_id", f"{DOCS_WHOLE} as markdown")


def docs_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "documents", "doc_id", f"{DOCS_NESTED} as markdown")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place first and the other columns from it: only what is stored is dealt out, and what groups by formula stays where it is."""
    place = f"row_number() over (partition by l_orderkey order by {ORDER})"
    rows = table(spark, sf_dir, "lineitem").withColumn("__n", F.expr(place))
    rows.createOrReplaceTempView("mathlake_lineitem")
    out = CANDIDATES.replace(place, "__n").replace("l_orderkey as formula_id", "l_orderkey")
    return spark.sql(f"select {out} from mathlake_lineitem").withColumnRenamed("l_orderkey", "formula_id")


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "orders", FORMULAS)

"""Queries over the driver's tables for every operator, and the SQL that says the same without this library."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fileloom.functions import formats as fm
from fileloom.functions import paged, tabular, text, tree
from fileloom.operators import audio, images
from fileloom.plans import batch, registry
from fileloom.sources import files as files_io
from fileloom.sources.tables import read_table as table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: spark.checkpoint.dir, or in a local session without one a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or tempfile.mkdtemp(prefix="fileloom-")).rstrip("/")


def as_text(result: Column) -> Column:
    return F.coalesce(result["output"].cast("string"), result["error"])


def to_bytes(value: Column) -> Column:
    return F.encode(value, "UTF-8")


# --- names and catalogue -----------------------------------------------------------------------------------------

# Endings that names of rows get in turn; '' stands for a name without a dot.
ENDINGS = ("png", "JPG", "Md", "tar.gz", "xyz", "", "html", "TEXT", "yml", "Flac", "jpeg", "tif", "exr", "avif", "svg", "mp3", "docx", "rtf", "pdf", "csv", "tsv", "json", "toml", "base64", "md", "ico", "dds")
_ENDINGS_SQL = "[" + ", ".join(f"'{e}'" for e in ENDINGS) + "]"
_NAMED_SQL = f"""select page_id, case when e = '' then 'page_' || page_id else 'page_' || page_id || '.' || e end as name
  from (select page_id, {_ENDINGS_SQL}[page_id % {len(ENDINGS)} + 1] as e from pages)"""
_KNOWN_SQL = "('png','jpg','jpeg','webp','gif','bmp','tiff','tif','avif','ico','qoi','tga','hdr','dds','exr','svg','md','markdown','html','txt','text','docx','rtf','csv','tsv','json','yaml','yml','toml','base64','mp3','flac','ogg','wav','pdf')"
_OUTPUTS_SQL = """(values ('png','jpg webp avif gif bmp tiff qoi tga ico'), ('jpg','png webp avif gif bmp tiff qoi tga ico'), ('jpeg','png webp avif gif bmp tiff qoi tga ico'),
  ('webp','png jpg avif gif bmp tiff qoi tga ico'), ('gif','png jpg webp avif bmp tiff qoi tga ico'), ('bmp','png jpg webp avif gif tiff qoi tga ico'),
  ('tiff','png jpg webp avif gif bmp qoi tga ico'), ('tif','png jpg webp avif gif bmp qoi tga ico'), ('ico','png jpg webp avif gif bmp tiff qoi tga'),
  ('qoi','png jpg webp avif gif bmp tiff tga ico'), ('tga','png jpg webp avif gif bmp tiff qoi ico'), ('hdr','png jpg webp avif bmp tiff tga'),
  ('dds','png jpg webp avif bmp tiff tga'), ('exr','png jpg webp avif bmp tiff tga'), ('svg','png'), ('mp3','wav'), ('flac','wav'), ('ogg','wav'), ('wav','wav'),
  ('md','html txt pdf'), ('markdown','html txt pdf'), ('html','md pdf'), ('docx','txt html'), ('rtf','txt'), ('pdf','txt html'), ('txt','pdf'), ('text','pdf'),
  ('csv','json tsv'), ('tsv','csv'), ('json','csv yaml toml'), ('yaml','json'), ('yml','json'), ('toml','json'), ('base64','bin')) as o(ext, outputs)"""


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, name: pages under names with all kinds of endings."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    stem = F.concat(F.lit("page_"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(ending == "", stem).otherwise(F.concat(stem, F.lit("."), ending)).alias("name"))


_EXT_SQL = f"select page_id, name, case when lower(list_extract(string_split(name, '.'), -1)) in {_KNOWN_SQL} then lower(list_extract(string_split(name, '.'), -1)) end as ext from ({_NAMED_SQL})"


@query(f"select page_id, name, ext from ({_EXT_SQL})")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("page_id", "name", fm.detect_format("name").alias("ext"))


@query(f"select page_id, coalesce(outputs, 'base64') as outputs from ({_EXT_SQL}) n left join {_OUTPUTS_SQL} on o.ext = n.ext")
def output_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.coalesce(fm.detect_format("name"), F.lit(""))
    return named(spark, sf_dir).select("page_id", F.array_join(fm.output_formats(ext), " ").alias("outputs"))


@query(f"select page_id, split_part(coalesce(outputs, 'base64'), ' ', 1) as target from ({_EXT_SQL}) n left join {_OUTPUTS_SQL} on o.ext = n.ext")
def default_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("page_id", fm.default_target(F.coalesce(fm.detect_format("name"), F.lit(""))).alias("target"))


_FORMATS_SQL = "(select unnest(['png','jpg','jpeg','webp','gif','bmp','tiff','tif','avif','ico','qoi','tga','hdr','dds','exr','svg','md','markdown','html','txt','text','docx','rtf','csv','tsv','json','yaml','yml','toml','base64','mp3','flac','ogg','wav','pdf','zzz']) as f)"
_IMAGES_SQL = "('png','jpg','jpeg','webp','gif','bmp','tiff','tif','ico','qoi','tga','hdr','dds','exr')"


@query(f"""select a.f as from_fmt, b.f as to_fmt, case
    when a.f in {_IMAGES_SQL} and (b.f in {_IMAGES_SQL} or b.f = 'avif') then 'image'
    when a.f = 'svg' and b.f = 'png' then 'svg_to_png'
    when a.f in ('md','markdown') and b.f = 'html' then 'markdown_to_html'
    when a.f in ('md','markdown') and b.f in ('txt','text') then 'markdown_to_text'
    when a.f in ('md','markdown') and b.f = 'pdf' then 'markdown_to_pdf'
    when a.f = 'html' and b.f in ('md','markdown') then 'html_to_markdown'
    when a.f = 'html' and b.f = 'pdf' then 'html_to_pdf'
    when a.f = 'docx' and b.f in ('txt','text') then 'docx_to_text'
    when a.f = 'docx' and b.f = 'html' then 'docx_to_html'
    when a.f = 'rtf' and b.f in ('txt','text') then 'rtf_to_text'
    when a.f = 'pdf' and b.f in ('txt','text') then 'pdf_to_text'
    when a.f = 'pdf' and b.f = 'html' then 'pdf_to_html'
    when a.f in ('txt','text') and b.f = 'pdf' then 'text_to_pdf'
    when a.f = 'csv' and b.f = 'json' then 'csv_to_json' when a.f = 'json' and b.f = 'csv' then 'json_to_csv'
    when a.f = 'csv' and b.f = 'tsv' then 'csv_to_tsv' when a.f = 'tsv' and b.f = 'csv' then 'tsv_to_csv'
    when a.f in ('mp3','flac','ogg','wav') and b.f = 'wav' then 'audio_to_wav'
    when a.f = 'base64' then 'base64_decode' when b.f = 'base64' then 'base64_encode'
    when a.f = 'json' and b.f in ('yaml','yml') then 'json_to_yaml' when a.f in ('yaml','yml') and b.f = 'json' then 'yaml_to_json'
    when a.f = 'toml' and b.f = 'json' then 'toml_to_json' when a.f = 'json' and b.f = 'toml' then 'json_to_toml' end as operator
  from {_FORMATS_SQL} a, {_FORMATS_SQL} b""")
def dispatch_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of formats with its operator: the catalogue against itself, whatever the data."""
    known = F.array(*map(F.lit, (*fm.KNOWN, "zzz")))
    pairs = spark.range(1).select(F.explode(known).alias("from_fmt")).withColumn("to_fmt", F.explode(known))
    return pairs.withColumn("operator", registry.operator_of(F.col("from_fmt"), F.col("to_fmt")))


@query("select '.png,.jpg,.jpeg,.webp,.gif,.bmp,.tiff,.tif,.ico,.qoi,.tga,.hdr,.dds,.exr,.svg,.mp3,.flac,.ogg,.wav,.md,.markdown,.html,.txt,.docx,.rtf,.pdf,.csv,.tsv,.json,.yaml,.yml,.toml,.base64' as accept")
def accept_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(fm.accept_list()).alias("accept"))


@query(f"""select f as fmt, f in {_IMAGES_SQL} as image_in, f in {_IMAGES_SQL} or f = 'avif' as image_out, f in ('mp3','flac','ogg','wav') as audio, f in {_KNOWN_SQL} as known,
    case when f in {_IMAGES_SQL} then case f when 'jpeg' then 'jpg' when 'tif' then 'tiff' else f end end as decoder,
    case when f in {_IMAGES_SQL} or f = 'avif' then case f when 'jpeg' then 'jpg' when 'tif' then 'tiff' else f end end as encoder
  from {_FORMATS_SQL}""")
def format_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("fmt")
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, (*fm.KNOWN, "zzz")))).alias("fmt"))
    return rows.select("fmt", fm.is_image_input(f).alias("image_in"), fm.is_image_output(f).alias("image_out"), fm.is_audio(f).alias("audio"), fm.is_known(f).alias("known"), fm.image_decoder(f).alias("decoder"), fm.image_encoder(f).alias("encoder"))


_SIZE_SQL = "case when {n} < 1024 then {n}::varchar || ' B' when {n} < 1048576 then printf('%.1f', {n} / 1024.0::double) || ' KB' else printf('%.1f', {n} / 1048576.0::double) || ' MB' end"


@query(f"select doc_id, {_SIZE_SQL.format(n='n_chars')} as own, {_SIZE_SQL.format(n='(n_chars * 64)')} as larger, {_SIZE_SQL.format(n='(n_chars * 65536)')} as largest from documents")
def format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", fm.format_size(n).alias("own"), fm.format_size(n * 64).alias("larger"), fm.format_size(n * 65536).alias("largest"))


@query(f"""select page_id, case ext when 'png' then 'image/png' when 'jpg' then 'image/jpeg' when 'jpeg' then 'image/jpeg' when 'tif' then 'image/tiff' when 'avif' then 'image/avif'
    when 'ico' then 'image/x-icon' when 'dds' then 'image/vnd.ms-dds' when 'exr' then 'image/x-exr' when 'html' then 'text/html' when 'md' then 'text/markdown' when 'text' then 'text/plain'
    when 'rtf' then 'application/rtf' when 'pdf' then 'application/pdf' when 'docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
    when 'csv' then 'text/csv' when 'tsv' then 'text/tab-separated-values' when 'json' then 'application/json' when 'yml' then 'application/x-yaml' when 'toml' then 'application/toml'
    else 'application/octet-stream' end as mime from ({_EXT_SQL})""")
def mime_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("page_id", fm.mime_type(F.coalesce(fm.detect_format("name"), F.lit(""))).alias("mime"))


@query(f"""select page_id, case when ext in {_IMAGES_SQL} or ext in ('svg', 'avif') then '🖼️' when ext in ('md','markdown','html','txt','text') then '📝'
    when ext in ('csv','tsv','json') then '📊' when ext in ('yaml','yml','toml') then '⚙️' when ext = 'base64' then '🔐' else '📄' end as icon from ({_EXT_SQL})""")
def format_icon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("page_id", fm.format_icon(F.coalesce(fm.detect_format("name"), F.lit(""))).alias("icon"))


@query(rf"select page_id, regexp_replace(name, '\.[^.]*$', '') || '.jpg' as output_name from ({_NAMED_SQL})")
def output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("page_id", fm.output_name("name", F.lit("jpg")).alias("output_name"))


@query("""select event_id, case when event_id % 400 < 256 then event_type end as from_fmt, case when event_id % 400 < 256 then 'pdf' end as to_fmt,
    case when event_id % 400 < 256 then (event_id % 400)::smallint end as quality,
    case when event_id % 400 >= 256 then 'Invalid config: quality is no number from 0 to 255' end as error from events""")
def parse_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = F.concat(F.lit('{"from":"'), F.col("event_type"), F.lit('","to":"pdf","extra":[1],"quality":'), (F.col("event_id") % 400).cast("string"), F.lit("}"))
    rows = table(spark, sf_dir, "events").select("event_id", registry.parse_config(config).alias("c"))
    return rows.select("event_id", F.col("c.from").alias("from_fmt"), F.col("c.to").alias("to_fmt"), "c.quality", "c.error")


# --- markup, entities, encoding ----------------------------------------------------------------------------------

_S = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _trim_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_S}+', ''), '{_S}+$', '')"


_MD_SQL = rf"""array_to_string(list_transform(regexp_extract_all(html, '(?s)<[^>]*>?|&[^;]*;?|[^<&]+'), lambda tok: case
    when tok[1] = '<' then case when tok[-1] <> '>' then '' else case lower({_trim_sql("regexp_replace(regexp_replace(tok, '(?s)^.*<', ''), '>$', '')")})
      when 'h1' then '# ' when 'h2' then '## ' when 'h3' then '### ' when '/h1' then chr(10) || chr(10) when '/h2' then chr(10) || chr(10) when '/h3' then chr(10) || chr(10)
      when '/h4' then chr(10) || chr(10) when '/h5' then chr(10) || chr(10) when '/h6' then chr(10) || chr(10) when '/p' then chr(10) || chr(10)
      when 'br' then chr(10) when 'br/' then chr(10) when 'br /' then chr(10) when 'strong' then '**' when 'b' then '**' when '/strong' then '**' when '/b' then '**'
      when 'em' then '*' when 'i' then '*' when '/em' then '*' when '/i' then '*' when 'code' then '`' when '/code' then '`' when 'li' then '- ' when '/li' then chr(10)
      when 'hr' then chr(10) || '---' || chr(10) when 'hr/' then chr(10) || '---' || chr(10) else '' end end
    when tok = '&amp;' then '&' when tok = '&lt;' then '<' when tok = '&gt;' then '>' when tok = '&quot;' then '"' when tok = '&#39;' then '''' else tok end), '')"""
_STRIP_SQL = _trim_sql("replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>?', '', 'g'), '>', ''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')")


@query(f"select page_id, {_trim_sql(_MD_SQL)} as markdown from pages")
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_markdown("html").alias("markdown"))


@query(f"select page_id, {_STRIP_SQL} as txt from pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags("html").alias("txt"))


@query("select page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped from pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_escape("html").alias("escaped"))


@query("select page_id, replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', '''') as decoded from pages")
def xml_entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.decode_xml("html").alias("decoded"))


@query("""select page_id, regexp_extract(html, 'lang="([^"]*)"', 1) as lang, regexp_extract(html, 'href="([^"]*)"', 1) as href from pages""")
def attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(text.attribute("html", "lang"), F.lit("")).alias("lang"), F.coalesce(text.attribute("html", "href"), F.lit("")).alias("href"))


@query(f"select doc_id, {_trim_sql('text')} as trimmed from documents")
def unicode_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.trim("text").alias("trimmed"))


@query("select doc_id, base64(encode(text)) as encoded from documents")
def base64_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", as_text(registry.convert(to_bytes(F.col("text")), "txt", "base64")).alias("encoded"))


@query("select doc_id, text as decoded from documents")
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit(" \n"), text.base64_encode(to_bytes(F.col("text"))), F.lit("\t"))
    return table(spark, sf_dir, "documents").select("doc_id", as_text(registry.convert(to_bytes(padded), "base64", "bin")).alias("decoded"))


@query("select doc_id, 'Invalid base64' as problem from documents where not regexp_full_match(text, '(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?')")
def base64_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", registry.convert(to_bytes(F.col("text")), "base64", "bin").alias("r"))
    return rows.where("r.error is not null").select("doc_id", F.substring_index("r.error", ":", 1).alias("problem"))


# --- pages of text -----------------------------------------------------------------------------------------------

_SEGMENTS_SQL = r"""select doc_id, case when text = '' then [''] else flatten(list_transform(string_split(regexp_replace(text, '\n$', ''), chr(10)),
    lambda l: case when l = '' then [''] else list_transform(range(0, (length(l) - 1) // 90 + 1), lambda k: substr(l, (k * 90 + 1)::bigint, 90)) end)) end as segments from documents"""


@query(f"select doc_id, ((pos - 1) // 52 + 1)::int as page, ((pos - 1) % 52 + 1)::int as line_on_page, txt from (select doc_id, unnest(segments) as txt, generate_subscripts(segments, 1) as pos from ({_SEGMENTS_SQL}))")
def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged.pages(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"select doc_id, ((len(segments) + 51) // 52)::bigint as pages from ({_SEGMENTS_SQL})")
def pdf_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", paged.page_count("text").cast("long").alias("pages"))


@query(r"""select doc_id, replace(replace(regexp_replace(regexp_replace(text, '[\x{00}-\x{09}\x{0B}\x{0C}\x{0E}-\x{1F}\x{100}-\x{10FFFF}]', '', 'g'), '([()\\])', '\\\1', 'g'), chr(13), '\r'), chr(10), '\n') as escaped from documents""")
def pdf_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.pdf_string("text").alias("escaped"))


_ASCII = r"[^\x20-\x7E]"


def _ascii_sql(body: str, lines: str) -> str:
    """What a PDF of a text reads as: its lines one after another, pages apart; only ASCII, as others change their encoding."""
    return f"select doc_id, regexp_replace({body}, '{_ASCII}', '', 'g') as txt from ({lines})"


@query(_ascii_sql("array_to_string(segments, '')", _SEGMENTS_SQL))
def text_pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to PDF and back."""
    made = registry.convert(to_bytes(F.col("text")), "txt", "pdf")["output"]
    rows = table(spark, sf_dir, "documents").select("doc_id", made.alias("pdf"))
    return rows.select("doc_id", F.regexp_replace(as_text(registry.convert("pdf", "pdf", "txt")), _ASCII, "").alias("txt"))


@query(f"""select doc_id, '<!DOCTYPE html><html><head><meta charset="utf-8"></head><body><pre>' || replace(replace(replace(txt, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</pre></body></html>' as html
    from ({_ascii_sql("array_to_string(segments, '')", _SEGMENTS_SQL)})""")
def pdf_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = registry.convert(to_bytes(F.col("text")), "txt", "pdf")["output"]
    rows = table(spark, sf_dir, "documents").select("doc_id", made.alias("pdf"))
    return rows.select("doc_id", F.regexp_replace(as_text(registry.convert("pdf", "pdf", "html")), _ASCII, "").alias("html"))


@query(f"select page_id, regexp_replace(replace({_STRIP_SQL}, chr(10), ''), '{_ASCII}', '', 'g') as txt from pages")
def html_pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML to PDF, and the PDF's text."""
    rows = table(spark, sf_dir, "pages").select("page_id", registry.convert(to_bytes(F.col("html")), "html", "pdf")["output"].alias("pdf"))
    return rows.select("page_id", F.regexp_replace(as_text(registry.convert("pdf", "pdf", "txt")), _ASCII, "").alias("txt"))


# --- tables ------------------------------------------------------------------------------------------------------


def _field_sql(x: str) -> str:
    return f"""case when regexp_matches({x}, '[",\\r\\n]') then '"' || replace({x}, '"', '""') || '"' else {x} end"""


@query(f"select conv_id, turn, conv_id || ',' || turn || ',' || {_field_sql('role')} || ',' || {_field_sql('text')} as record from conversations")
def csv_encode_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.array(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tabular.csv_row(fields).alias("record"))


@query("""select c_custkey, col, kind, json from (
    select c_custkey, 'key' as col, 'int' as kind, c_custkey::varchar as json from customer
    union all select c_custkey, 'padded', 'int', c_custkey::varchar from customer
    union all select c_custkey, 'thousands', 'float', (c_custkey * 1000)::varchar || '.0' from customer
    union all select c_custkey, 'balance', 'float', c_acctbal::varchar from customer
    union all select c_custkey, 'spaced', 'string', '" ' || c_custkey || '"' from customer
    union all select c_custkey, 'name', 'string', '"' || c_name || '"' from customer
    union all select c_custkey, 'endless', 'string', '"inf"' from customer)""")
def csv_cell_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    cells = {"key": key, "padded": F.concat(F.lit("+00"), key), "thousands": F.concat(key, F.lit("e3")), "balance": F.col("c_acctbal").cast("string"), "spaced": F.concat(F.lit(" "), key), "name": F.col("c_name"), "endless": F.lit("inf")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("col"), v.alias("cell")) for k, v in cells.items()]))
    rows = table(spark, sf_dir, "customer").select("c_custkey", each.alias("x"))
    return rows.select("c_custkey", "x.col", tabular.cell_kind("x.cell").alias("kind"), tabular.cell_json("x.cell").alias("json"))


@query("""select event_id, 'k,z' || chr(10) || coalesce(json_extract_string(props, '$.k'), '') || ',' || chr(10) || ',"a,b"' || chr(10) as csv from events""")
def json_to_csv_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("["), F.col("props"), F.lit(',{"z":"a,b"}]'))
    return table(spark, sf_dir, "events").select("event_id", tabular.json_objects_to_csv(body).alias("csv"))


@query("""select event_id, 'k,list,z' || chr(10) || coalesce(json_extract_string(props, '$.k'), '') || ',,' || chr(10) || ',"[1,{""q"":null}]",null' || chr(10) as csv from events""")
def json_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("["), F.col("props"), F.lit(', 7, {"z":null, "list":[1, {"q": null}]}]'))
    return table(spark, sf_dir, "events").select("event_id", as_text(registry.convert(to_bytes(body), "json", "csv")).alias("csv"))


def conversation_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(tabular.table_to_csv(rows, "turn", ["turn", "role", "text"]).alias("csv"))


@query("""select conv_id, 'turn' || chr(9) || 'role' || chr(9) || 'text' || chr(10) || string_agg(turn || chr(9) || role || chr(9) || text || chr(10), '' order by turn) as tsv from conversations group by conv_id""")
def csv_to_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_csv(spark, sf_dir).select("conv_id", as_text(registry.convert(to_bytes(F.col("csv")), "csv", "tsv")).alias("tsv"))


_JSON_STRING_SQL = r"""'"' || replace(replace(replace({x}, '\', '\\'), '"', '\"'), chr(10), '\n') || '"'"""


@query(f"""select conv_id, '[' || chr(10) || string_agg('  {{' || chr(10) || '    "role": "' || role || '",' || chr(10) || '    "text": ' || {_JSON_STRING_SQL.format(x="text")} || ',' || chr(10)
    || '    "turn": ' || turn || chr(10) || '  }}', ',' || chr(10) order by turn) || chr(10) || ']' as json from conversations group by conv_id""")
def csv_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_csv(spark, sf_dir).select("conv_id", as_text(registry.convert(to_bytes(F.col("csv")), "csv", "json")).alias("json"))


@query("""select c_nationkey, string_agg(c_custkey || ',"' || c_name || ', ' || repeat('"', 2) || 'q' || repeat('"', 3) || ',' || c_mktsegment || chr(10), '' order by c_custkey) as csv from customer group by c_nationkey""")
def tsv_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("\t", F.col("c_custkey").cast("string"), F.concat("c_name", F.lit(', "q"')), "c_mktsegment")
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\r\n")
    return rows.select("c_nationkey", as_text(registry.convert(to_bytes(body), "tsv", "csv")).alias("csv"))


# --- trees -------------------------------------------------------------------------------------------------------


@query("select event_id, 'k: ' || json_extract_string(props, '$.k') || chr(10) as yaml from events")
def json_to_yaml_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tree.flat_json_to_yaml("props").alias("yaml"))


@query("select event_id, 'k = ' || json_extract_string(props, '$.k') || chr(10) as toml from events")
def json_to_toml_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tree.flat_json_to_toml("props").alias("toml"))


def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"a":{"props":'), F.col("props"), F.lit(',"event":"'), F.col("event_type"), F.lit('","xs":[1,null]}}'))
    return table(spark, sf_dir, "events").select("event_id", to_bytes(body).alias("json"))


@query("""select event_id, 'a: event: ' || event_type || chr(10) || '  props: k: ' || json_extract_string(props, '$.k') || chr(10) || '  xs: - 1' || chr(10) || '    - null' || chr(10) || 'id: ' || event_id || chr(10) as yaml from events""")
def json_to_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_json(spark, sf_dir).select("event_id", as_text(registry.convert("json", "json", "yaml")).alias("yaml"))


@query("""select event_id, 'id = ' || event_id || chr(10) || chr(10) || '[a]' || chr(10) || 'event = "' || event_type || '"' || chr(10) || 'xs = [1, ""]' || chr(10) || chr(10) || '[a.props]' || chr(10) || 'k = '
    || json_extract_string(props, '$.k') || chr(10) as toml from events""")
def json_to_toml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_json(spark, sf_dir).select("event_id", as_text(registry.convert("json", "json", "toml")).alias("toml"))


@query("""select c_custkey, '{' || chr(10) || '  "- item": "x",' || chr(10) || '  "balance": ' || c_acctbal || ',' || chr(10) || '  "id": ' || c_custkey || ',' || chr(10) || '  "name": "' || c_name || '",' || chr(10)
    || '  "none": null,' || chr(10) || '  "url": "http://h/p # no comment",' || chr(10) || '  "yes": true' || chr(10) || '}' as json from customer""")
def yaml_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("---\nid: 0\nname:\n    name: '"), F.col("c_name"), F.lit("'\n# comment\nbalance: "), F.col("c_acctbal").cast("string"), F.lit("\nnone: ~\nyes: true\n- item: x\n- lost\nurl: http://h/p # no comment\nid: "), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", as_text(registry.convert(to_bytes(body), "yaml", "json")).alias("json"))


@query("""select c_custkey, '{' || chr(10) || '  "a.b": {' || chr(10) || '    "balance": ' || c_acctbal || ',' || chr(10) || '    "list": "[1, 2]"' || chr(10) || '  },' || chr(10) || '  "id": ' || c_custkey || ',' || chr(10)
    || '  "name": "' || c_name || '"' || chr(10) || '}' as json from customer""")
def toml_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("id = 1\nname = '"), F.col("c_name"), F.lit("'\nid = +00"), F.col("c_custkey").cast("string"), F.lit("\n\n[empty]\n[id]\nlost = 1\n[a.b]\n# c\nlist = [1, 2]\nbalance = "), F.col("c_acctbal").cast("string"), F.lit("\n"))
    return table(spark, sf_dir, "customer").select("c_custkey", as_text(registry.convert(to_bytes(body), "toml", "json")).alias("json"))


# --- Markdown, DOCX, RTF -----------------------------------------------------------------------------------------


def customer_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("# "), F.col("c_name"), F.lit("\n\n- **"), F.col("c_mktsegment"), F.lit("** & `<x>`\n- key *"), F.col("c_custkey").cast("string"), F.lit("*\n\n> quoted\n"))
    return table(spark, sf_dir, "customer").select("c_custkey", to_bytes(body).alias("md"))


@query("""select c_custkey, '<h1>' || c_name || '</h1>' || chr(10) || '<ul>' || chr(10) || '<li><strong>' || c_mktsegment || '</strong> &amp; <code>&lt;x&gt;</code></li>' || chr(10) || '<li>key <em>' || c_custkey || '</em></li>' || chr(10)
    || '</ul>' || chr(10) || '<blockquote>' || chr(10) || '<p>quoted</p>' || chr(10) || '</blockquote>' || chr(10) as html from customer""")
def markdown_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_markdown(spark, sf_dir).select("c_custkey", as_text(registry.convert("md", "md", "html")).alias("html"))


_MARKDOWN_TEXT_SQL = "c_name || chr(10) || chr(10) || c_mktsegment || ' & <x>' || chr(10) || 'key ' || c_custkey || chr(10) || chr(10) || chr(10) || 'quoted'"


@query(f"select c_custkey, {_MARKDOWN_TEXT_SQL} as txt from customer")
def markdown_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_markdown(spark, sf_dir).select("c_custkey", as_text(registry.convert("md", "markdown", "txt")).alias("txt"))


@query(f"select c_custkey, replace({_MARKDOWN_TEXT_SQL}, chr(10), '') as txt from customer")
def markdown_pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown to PDF, and the PDF's text."""
    rows = customer_markdown(spark, sf_dir).select("c_custkey", registry.convert("md", "md", "pdf")["output"].alias("pdf"))
    return rows.select("c_custkey", as_text(registry.convert("pdf", "pdf", "txt")).alias("txt"))


def conversation_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    paragraph = F.concat(F.lit('<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">'), text.html_escape("text"), F.lit("</w:t></w:r>ignored</w:p>"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", paragraph.alias("p")))).alias("p"))
    return rows.select("conv_id", F.concat(F.lit("<w:document><w:body>"), F.array_join(F.transform("p", lambda x: x["p"]), ""), F.lit("</w:body></w:document>")).alias("xml"))


_CONVERSATION_TEXT_SQL = f"select conv_id, {_trim_sql('string_agg(text, chr(10) || chr(10) order by turn)')} as txt from conversations group by conv_id"


@query(_CONVERSATION_TEXT_SQL)
def docx_xml_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_xml(spark, sf_dir).select("conv_id", paged.wordml_text("xml").alias("txt"))


def zipped(xml: Column) -> Column:
    """A DOCX file around its document."""

    @F.arrow_udf("binary")
    def pack(v: pa.Array) -> pa.Array:
        from fileloom.operators.archives import create_zip

        return pa.array([create_zip([("[Content_Types].xml", b"<Types/>"), ("Word/Document.xml", x.as_py().encode())]) for x in v], pa.binary())

    return pack(xml)


@query(_CONVERSATION_TEXT_SQL)
def docx_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_xml(spark, sf_dir).select("conv_id", zipped(F.col("xml")).alias("docx"))
    return rows.select("conv_id", as_text(registry.convert("docx", "docx", "txt")).alias("txt"))


@query("""select conv_id, '<html><body>' || chr(10) || string_agg('<h2><strong>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</strong></h2>' || chr(10), '' order by turn) || '</body></html>' as html
    from conversations group by conv_id""")
def docx_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_xml(spark, sf_dir).select("conv_id", zipped(F.col("xml")).alias("docx"))
    return rows.select("conv_id", as_text(registry.convert("docx", "docx", "html")).alias("html"))


@query("select c_custkey, 'Times;' || c_name || ' {bold}' || c_mktsegment as txt from customer")
def rtf_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("{\\rtf1\\ansi{\\fonttbl {\\f0 Times;}}\\f0\\fs24 "), F.col("c_name"), F.lit(" {\\b \\{bold\\}}\\par\n"), F.col("c_mktsegment"), F.lit("}"))
    return table(spark, sf_dir, "customer").select("c_custkey", as_text(registry.convert(to_bytes(body), "rtf", "txt")).alias("txt"))


@query("""select c_custkey, 'Invalid UTF-8: invalid byte at position ' || (3 + strlen(c_name)) as error from customer""")
def utf8_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown with a byte that UTF-8 has not: the error says where it stands."""
    body = F.concat(F.lit("é ").cast("binary"), to_bytes(F.col("c_name")), F.unhex(F.lit("FF")), F.lit(" x").cast("binary"))
    return table(spark, sf_dir, "customer").select("c_custkey", registry.convert(body, "md", "html")["error"].alias("error"))


@query(f"""select doc_id, 3 + 2 * n as objects, 4 + 2 * n as size, true as table_found, true as objects_found
    from (select doc_id, ((count(*) - 1) // {paged.PAGE_LINES} + 1) as n from (select doc_id, unnest(segments) from ({_SEGMENTS_SQL})) group by doc_id)""")
def pdf_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of PDFs: how many, what the trailer says, and whether the table and each object stand where it is said."""
    done = registry.convert(to_bytes(F.coalesce("text", F.lit(""))), "txt", "pdf")["output"]
    rows = table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(F.struct(F.decode(done, "ISO-8859-1").alias("pdf")))))
    start = F.regexp_extract("pdf", r"startxref\n([0-9]+)\n%%EOF\n$", 1).cast("int")
    offsets = F.regexp_extract_all(F.substring(F.col("pdf"), start + 1, F.length("pdf")), F.lit(r"([0-9]{10}) 00000 n"), F.lit(1))
    stands = lambda o, k: F.startswith(F.substring(F.col("pdf"), o.cast("int") + 1, F.lit(20)), F.concat((k + 1).cast("string"), F.lit(" 0 obj\n")))
    return rows.select(
        "doc_id", F.regexp_count("pdf", F.lit(r"(?m)^[0-9]+ 0 obj$")).cast("long").alias("objects"), F.regexp_extract("pdf", r"trailer\n<< /Size ([0-9]+)", 1).cast("long").alias("size"),
        F.startswith(F.substring(F.col("pdf"), start + 1, F.lit(5)), F.lit("xref\n")).alias("table_found"), F.forall(F.transform(offsets, stands), lambda x: x).alias("objects_found"),
    )


# --- sound and pictures ------------------------------------------------------------------------------------------

_PCM_SQL = "select vec_id, (pos - 1)::int as pos, trunc(greatest(-1::float, least(1::float, x)) * 32767::float)::smallint as sample from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings)"


@query(_PCM_SQL)
def pcm16_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(paged.pcm16("embedding")).alias("pos", "sample"))


@query(f"select vec_id, pos, trunc(sample::float / 32768::float * 32767::float)::smallint as sample from ({_PCM_SQL})")
def wav_to_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 16-bit WAV files, read and written again."""

    @F.arrow_udf("binary")
    def made(v: pa.Array) -> pa.Array:
        import numpy as np

        # the head is for all samples alike; encode_wav quantises as pcm16 does
        return pa.array([audio.encode_wav(np.array(x.as_py(), np.float32), 1, 16000) for x in v], pa.binary())

    @F.arrow_udf("array<smallint>")
    def samples(v: pa.Array) -> pa.Array:
        import numpy as np

        return pa.array([np.frombuffer(x.as_py()[44:], "<i2") for x in v], pa.list_(pa.int16()))

    rows = table(spark, sf_dir, "embeddings").select("vec_id", made("embedding").alias("wav"))
    return rows.select("vec_id", F.posexplode(samples(registry.convert("wav", "wav", "wav")["output"])).alias("pos", "sample"))


def _flac(samples, rate: int) -> bytes:
    """16 bits, one channel, verbatim blocks of up to 4,096 samples."""
    import struct

    blocks = []
    for k in range(0, len(samples), 4096):
        x = samples[k : k + 4096]
        # block of a size that follows, sample rate of the head, one channel, 16 bits, number of the block, size
        head = bytes([0xFF, 0xF8, 0x70, 0x08, k // 4096]) + struct.pack(">H", len(x) - 1)
        blocks.append(head + bytes([audio._crc8(head), 0x02]) + x.astype(">i2").tobytes() + b"\0\0")
    info = struct.pack(">HH", 4096, 4096) + bytes(6) + (rate << 44 | 15 << 36 | len(samples)).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(blocks)


@query(f"select vec_id, pos, trunc(sample::float / 32768::float * 32767::float)::smallint as sample from ({_PCM_SQL})")
def flac_to_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as FLAC files, converted to WAV."""

    @F.arrow_udf("binary")
    def made(v: pa.Array) -> pa.Array:
        import numpy as np

        return pa.array([_flac(np.array(x.as_py(), np.int16), 16000) for x in v], pa.binary())

    @F.arrow_udf("array<smallint>")
    def samples(v: pa.Array) -> pa.Array:
        import numpy as np

        return pa.array([np.frombuffer(x.as_py()[44:], "<i2") for x in v], pa.list_(pa.int16()))

    rows = table(spark, sf_dir, "embeddings").select("vec_id", made(paged.pcm16("embedding")).alias("flac"))
    return rows.select("vec_id", F.posexplode(samples(registry.convert("flac", "flac", "wav")["output"])).alias("pos", "sample"))


@query("""select n_nationkey, (n_nationkey + 9)::int as width, (n_nationkey + 4)::int as height, printf('%02x0a14ff', n_nationkey * 10) as pixel from nation""")
def ico_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Icons of three pictures, the largest at the front, in the middle or at the end: that one is converted."""

    @F.arrow_udf("binary")
    def made(v: pa.Array) -> pa.Array:
        import struct

        import numpy as np

        out = []
        for k in v.to_pylist():
            sizes = [(3, 5), (k + 8, k + 3)]
            sizes.insert(k % 3, (k + 9, k + 4))
            pngs = [images.encode_png(np.tile(np.array([k * 10, 10, 20, 255] if size == (k + 9, k + 4) else [1, 2, 3, 255], np.uint8), (size[1], size[0], 1))) for size in sizes]
            at = 6 + 16 * len(pngs) + np.cumsum([0, *map(len, pngs)])
            entries = b"".join(struct.pack("<BBBBHHII", w, h, 0, 0, 1, 32, len(png), int(a)) for (w, h), png, a in zip(sizes, pngs, at, strict=False))
            out.append(struct.pack("<HHH", 0, 1, len(pngs)) + entries + b"".join(pngs))
        return pa.array(out, pa.binary())

    @F.arrow_udf("struct<width: int, height: int, pixel: string>")
    def seen(v: pa.Array) -> pa.Array:
        a = [images.decode_png(x.as_py()) for x in v]
        return pa.array([{"width": x.shape[1], "height": x.shape[0], "pixel": x[-1, -1].tobytes().hex()} for x in a], pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixel", pa.string())]))

    rows = table(spark, sf_dir, "nation").select("n_nationkey", made("n_nationkey").alias("ico"))
    rows = rows.select("n_nationkey", seen(registry.convert("ico", "ico", "png")["output"]).alias("s"))
    return rows.select("n_nationkey", "s.width", "s.height", "s.pixel")


# Lossless targets a picture passes through.
LOSSLESS = ("png", "bmp", "gif", "tiff", "qoi", "tga", "ico", "webp")


#: Width and height of the pictures that parts get; their colors run along both.
PICTURE = (7, 5)
_PICTURE_SQL = """(select p_partkey, string_agg(printf('%02x%02x%02xff', ((p_partkey + 31 * x) % 256)::int, ((p_partkey * 7 + 17 * y) % 256)::int, ((p_partkey * 13 + 5 * x * y) % 256)::int), '' order by y, x) as pixels
    from part, (select unnest(range(7)) as x), (select unnest(range(5)) as y) group by p_partkey)"""


def pictures(keys: pa.Array) -> pa.Array:
    """A PNG for each key, no two of its rows and columns alike."""
    import numpy as np

    y, x = np.mgrid[: PICTURE[1], : PICTURE[0]]
    solid = np.full_like(x, 255)
    return pa.array([images.encode_png(np.stack([(k + 31 * x) % 256, (k * 7 + 17 * y) % 256, (k * 13 + 5 * x * y) % 256, solid], -1).astype(np.uint8)) for k in keys.to_pylist()], pa.binary())


@query(f"""select p_partkey, fmt, sha256(unhex(pixels)) as pixels from {_PICTURE_SQL}, (select unnest([{", ".join(f"'{x}'" for x in LOSSLESS)}]) as fmt)""")
def image_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture for each part, from PNG to each lossless format and back to PNG: a digest of all its pixels, row by row."""
    made = F.arrow_udf(lambda v: pictures(v), "binary")

    @F.arrow_udf("string")
    def digest(v: pa.Array) -> pa.Array:
        import hashlib

        return pa.array([hashlib.sha256(images.decode_png(x.as_py()).tobytes()).hexdigest() if x.is_valid else None for x in v], pa.string())

    rows = table(spark, sf_dir, "part").select("p_partkey", made("p_partkey").alias("png")).withColumn("fmt", F.explode(F.array(*map(F.lit, LOSSLESS))))
    there = registry.converted(rows, F.col("png"), F.lit("png"), F.col("fmt")).select("p_partkey", "fmt", F.col("__output").alias("there"))
    back = registry.converted(there, F.col("there"), F.col("fmt"), F.lit("png"))
    return back.select("p_partkey", "fmt", digest("__output").alias("pixels"))


@query("select n_nationkey, (n_nationkey + 1)::int as width, 5 as height, printf('%02x%02x%02xff', n_nationkey * 10, 200 - n_nationkey, 7) as pixel from nation")
def svg_to_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    body = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="4.5"><rect width="100%%" height="9" fill="#%02x%02x07"/></svg>', k + 1, k * 10, F.lit(200) - k)

    @F.arrow_udf("struct<width: int, height: int, pixel: string>")
    def seen(v: pa.Array) -> pa.Array:
        a = [images.decode_png(x.as_py()) for x in v]
        return pa.array([{"width": x.shape[1], "height": x.shape[0], "pixel": x[0, 0].tobytes().hex()} for x in a], pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixel", pa.string())]))

    rows = table(spark, sf_dir, "nation").select("n_nationkey", seen(registry.convert(to_bytes(body), "svg", "png")["output"]).alias("s"))
    return rows.select("n_nationkey", "s.width", "s.height", "s.pixel")


# JPEG qualities that pictures get in turn, and how far a color may be off on average.
QUALITIES = {30: 16.0, 75: 7.0, 95: 3.0}


@query("select p_partkey, [30, 75, 95][p_partkey % 3 + 1]::int as quality, 'ffd8' as mark, 9 as width, 7 as height, true as near from part")
def png_to_jpg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JPEG of each part's picture: its mark, its dimensions, and whether all its colors are near the original's at its quality."""

    def colors(k: int):
        import numpy as np

        y, x = np.mgrid[:7, :9]
        return np.stack([k % 128 + 8 * x, k * 7 % 128 + 9 * y, k * 13 % 128 + 4 * x + 3 * y, np.full_like(x, 255)], -1).astype(np.uint8)

    @F.arrow_udf("binary")
    def made(v: pa.Array) -> pa.Array:
        return pa.array([images.encode_png(colors(k)) for k in v.to_pylist()], pa.binary())

    @F.arrow_udf("struct<mark: string, width: int, height: int, near: boolean>")
    def seen(key: pa.Array, quality: pa.Array, v: pa.Array) -> pa.Array:
        import numpy as np

        out = []
        for k, q, x in zip(key.to_pylist(), quality.to_pylist(), v, strict=True):
            a = images.decode(x.as_py(), "jpg")
            off = np.abs(a[..., :3].astype(float) - colors(k)[..., :3]).mean() if a.shape[:2] == (7, 9) else np.inf
            out.append({"mark": x.as_py()[:2].hex(), "width": a.shape[1], "height": a.shape[0], "near": bool(off <= QUALITIES[q])})
        return pa.array(out, pa.struct([("mark", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("near", pa.bool_())]))

    asked = F.element_at(F.array(*map(F.lit, QUALITIES)), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", asked.alias("quality"), made("p_partkey").alias("png"))
    done = rows.select("p_partkey", "quality", seen("p_partkey", "quality", registry.convert("png", "png", "jpeg", F.col("quality"))["output"]).alias("s"))
    return done.select("p_partkey", "quality", "s.mark", "s.width", "s.height", "s.near")


# --- batches and archives ----------------------------------------------------------------------------------------


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, documents and customers as files: HTML, text and JSON, and some of unknown format."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".HTML")).alias("name"), to_bytes(F.col("html")).alias("content"))
    ending = F.when(F.col("doc_id") % 10 == 0, ".dat").otherwise(".txt")
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000_000).alias("file_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ending).alias("name"), to_bytes(F.col("text")).alias("content"))
    broken = F.concat(F.lit('{"name":'), F.when(F.col("c_custkey") % 3 == 0, "").otherwise('"x"'), F.lit("}"))
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 2_000_000_000).alias("file_id"), F.concat("c_name", F.lit(".json")).alias("name"), to_bytes(broken).alias("content"))
    return pages.unionByName(docs).unionByName(customers)


@query("""select 'html' as extension, 'md' as target, 'done' as status, count(*) as n, null as problem from pages
    union all select 'txt', 'pdf', 'done', count(*), null from documents where doc_id % 10 <> 0
    union all select '', 'base64', 'done', count(*), null from documents where doc_id % 10 = 0
    union all select 'json', 'csv', 'error', count(*), case when c_custkey % 3 = 0 then 'Invalid JSON' else 'JSON must be an array of objects' end from customer group by 5""")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = batch.convert_all(batch.ingest(files(spark, sf_dir), "file_id"))
    return done.groupBy("extension", "target", "status", F.substring_index("error", ":", 1).alias("problem")).agg(F.count("*").alias("n"))


@query("""with n as (select (select count(*) from pages) + (select count(*) from documents) + (select count(*) from customer) as n, (select count(*) from customer) as e)
    select 'before' as moment, true as has_files, false as all_done, true as can_convert, 0::bigint as done_count, n as pending_count from n
    union all select 'after', true, true, false, n - e, 0 from n""")
def batch_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = batch.ingest(files(spark, sf_dir), "file_id")
    each = [batch.summary(b).select(F.lit(moment).alias("moment"), "*") for moment, b in (("before", before), ("after", batch.convert_all(before)))]
    return each[0].unionByName(each[1])


@query("""select page_id as id, case when page_id = 3 then 'pdf' else 'md' end as target, case when page_id = 3 then 'pending' else 'done' end as status, page_id <> 3 as has_output from pages""")
def retarget(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = files(spark, sf_dir).where(F.endswith("name", F.lit(".HTML")))
    done = batch.set_target(batch.convert_all(batch.ingest(pages, "file_id")), 3, "pdf")
    return done.select("id", "target", "status", F.col("output").isNotNull().alias("has_output"))


@query("""select page_id as id, 'page_' || page_id || '.HTML' as name, strlen(html)::bigint as size from pages where page_id <> 3""")
def remove_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = files(spark, sf_dir).where(F.endswith("name", F.lit(".HTML")))
    return batch.remove_file(batch.ingest(pages, "file_id"), 3).select("id", "name", "size")


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns as files of an unknown format, in Base64; some names are the same."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("file_id"), F.concat(F.lit("c"), (F.col("conv_id") % 50).cast("string"), F.lit("."), F.col("role")).alias("name"), to_bytes(F.col("text")).alias("content"))
    return batch.convert_all(batch.ingest(rows, "file_id"))


@query("""select s_suppkey || '-' || s_name || '.base64' as name, strlen(base64(encode(s_name || ' é')))::bigint as length, sha256(base64(encode(s_name || ' é'))) as sha256, null as error from supplier""")
def saved_and_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files that are converted, saved to a shared folder and scanned again."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), F.concat("s_name", F.lit(".dat")).alias("name"), to_bytes(F.concat("s_name", F.lit(" é"))).alias("content"))
    folder = f"{shared_folder(spark)}/fileloom-saved-{uuid.uuid4().hex}"
    files_io.save(batch.convert_all(batch.ingest(rows, "file_id")), folder)
    return files_io.scan(spark, folder).select("name", "length", F.sha2("content", 256).alias("sha256"), "error")


_ENTRIES_SQL = "select conv_id * 1000 + turn as id, 'c' || (conv_id % 50) || '.base64' as name, base64(encode(text)) as data from conversations"
_ARCHIVE_SQL = f"""select (row_number() over (order by id) - 1)::int as position, case when k = 1 then name else replace(name, '.base64', ' (' || (k - 1) || ').base64') end as name, strlen(data)::bigint as size, sha256(data) as sha256
    from (select *, row_number() over (partition by name order by id) as k from ({_ENTRIES_SQL}))"""


@query(f"select id, name, strlen(data)::bigint as size, sha256(data) as sha256 from ({_ENTRIES_SQL})")
def archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.manifest(encoded(spark, sf_dir))


def _archive(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The archives' entries, read back out of them; volumes of 64 MB go on one after the other, and so are one sequence."""
        rows = batch.unpack(batch.pack(encoded(spark, sf_dir), fmt), fmt)
        return rows.select("position", "name", F.octet_length("data").cast("long").alias("size"), F.sha2("data", 256).alias("sha256"))

    run.__name__ = "archive_" + fmt.replace(".", "_")
    return run


for _fmt in ("zip", "tar.gz", "tar.xz", "7z"):
    query(_ARCHIVE_SQL)(_archive(_fmt))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a batch of HTML files, converted to their default target."""
    pages = files(spark, sf_dir).where(F.endswith("name", F.lit(".HTML")))
    done = batch.convert_all(batch.ingest(pages, "file_id"))
    return done.select("id", fm.output_name("name", F.col("target")).alias("output_name"), "status", F.col("output").cast("string").alias("markdown"), fm.format_size("size").alias("size_text"))

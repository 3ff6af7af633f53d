"""Fixed schemas of the engine's tables."""

from pyspark.sql import types as T

PAGES = "doc_id INT, url STRING, title STRING, content STRING, content_hash STRING, status_code INT, content_length INT, depth INT, raw_html_path STRING, crawled_at TIMESTAMP"
LINKS = "from_url STRING, to_url STRING, discovered_at TIMESTAMP"
FRONTIER = "url STRING, status STRING, depth INT, discovered_at TIMESTAMP"
PAGERANK = "url STRING, score DOUBLE"
CORPUS_JSON = "id INT, title STRING, content STRING, url STRING, company STRING"
FETCHED = "url STRING, html STRING, status_code INT, final_url STRING, content_length INT"
STRUCTURED_QUERY = T.StructType(
    [
        T.StructField("required", T.ArrayType(T.StringType())),
        T.StructField("optional", T.ArrayType(T.StringType())),
        T.StructField("excluded", T.ArrayType(T.StringType())),
        T.StructField("phrases", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("excluded_phrases", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)

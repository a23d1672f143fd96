"""The queries of this subpackage and the SQL they are held against, where SQL can express them."""

from rivulet.llm import bpe, jaccard, license, mixing, pii, quality, spherical, topk, url_filter, warc_zip

MODULES = (license, bpe, spherical, warc_zip, pii, jaccard, quality, mixing, topk, url_filter)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE", {}).items()}

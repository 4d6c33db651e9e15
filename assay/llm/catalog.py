"""The queries over the operators of this subpackage, each with its SQL where SQL can express it.

Importing the modules registers them; `corpus_pipeline` adds the pipeline.
"""

import importlib

from assay.llm.registry import ORACLE, QUERIES

for _module in ("token_queries", "langid_queries", "mixing_queries", "line_queries", "decontam_queries", "topk_queries", "minhash_queries", "toxicity_queries", "pseudo_lm_queries", "suffix_queries", "codes_queries", "sharding_queries", "turns_queries"):
    importlib.import_module(f"assay.llm.{_module}")

__all__ = ["ORACLE", "QUERIES"]

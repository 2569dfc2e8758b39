"""quillgraph: annotated documents, overlays and streams as Spark DataFrames."""

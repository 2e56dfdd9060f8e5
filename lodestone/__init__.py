"""Evidence retrieval, screening and ranking evaluation as Spark plans."""

"""fathomline: document retrieval and data-processing operators declared as Spark plans."""

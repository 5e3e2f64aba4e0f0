"""Page-tree export and document processing as Spark jobs."""

"""vellumine: media-curation analytics and corpus operators, expressed as Spark DataFrame plans."""

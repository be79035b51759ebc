"""keepsake: photo curation and feedback analytics as Spark DataFrame jobs."""

"""rxweave: prescription and lab analytics as Spark jobs."""

"""Parameters, stages, pipelines, graphs, persistence and the vector representation."""

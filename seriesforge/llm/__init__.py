"""Operations of a large-scale training-data pipeline, one module for each."""

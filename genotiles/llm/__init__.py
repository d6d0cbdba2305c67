"""Operations of a training-data pipeline: scoring, filtering, de-duplication, archives, packing."""

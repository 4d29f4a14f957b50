"""Operations of a training-data pipeline: dedup, formatting, scans, quality, packing, output."""

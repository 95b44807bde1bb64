"""Operations of a training-data pipeline: cleaning, near-duplicates, mixing,
scans and sharding over tables of documents. Nothing else in the library
imports this package."""

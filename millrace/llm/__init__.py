"""Operations of a training-data pipeline on tables of documents. Nothing else in the package imports these."""

"""Operations for training-data pipelines on Spark. Nothing else in the package imports this folder."""

"""Operations on pages, versions, the log and users: DataFrames in, a DataFrame out."""

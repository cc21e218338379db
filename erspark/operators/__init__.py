"""erspark.operators"""

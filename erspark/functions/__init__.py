"""erspark.functions"""

"""confluo.functions"""
